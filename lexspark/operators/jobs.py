"""A work queue as a table of states: pending, claimed, done, failed."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators.store import stored
from lexspark.operators.versions import Change, Snapshot, Store, Table


def enqueue(queue: DataFrame, jobs: DataFrame) -> DataFrame:
    """queue(id, state, error) with the jobs(id) that it lacks, pending."""
    new = jobs.select("id").distinct().join(queue, "id", "left_anti")
    return queue.unionByName(new.select("id", F.lit("pending").alias("state"), F.lit(None).cast("string").alias("error")))


def claim(queue: DataFrame, n: int) -> DataFrame:
    """The queue with the first n pending jobs, by id, claimed."""
    mine = queue.where("state = 'pending'").orderBy("id").limit(n).select("id", F.lit(True).alias("mine"))
    return queue.join(mine, "id", "left").select("id", F.when(F.col("mine"), "claimed").otherwise(F.col("state")).alias("state"), "error")


def settle(queue: DataFrame, results: DataFrame) -> DataFrame:
    """The queue after results(id, error): claimed jobs are done, or failed where there is an error."""
    x = queue.join(results.select("id", F.col("error").alias("e"), F.lit(True).alias("settled")), "id", "left")
    hit = (F.col("state") == "claimed") & F.coalesce("settled", F.lit(False))
    return x.select("id", F.when(hit, F.when(F.col("e").isNull(), "done").otherwise("failed")).otherwise(F.col("state")).alias("state"), F.when(hit, F.col("e")).otherwise(F.col("error")).alias("error"))


def recover(queue: DataFrame) -> DataFrame:
    """The queue with what a lost worker had claimed pending again."""
    return queue.withColumn("state", F.when(F.col("state") == "claimed", "pending").otherwise(F.col("state")))

TABLE = Table("id string, state string, worker string, token string, until double, error string, tries int", ("id",))


class Queue:
    """The queue as a versioned table, for several workers.

    A claim is a commit, so no two workers get one job: of two that see the same version one is
    first, and the other one chooses again. A claim ends at the time `until`; from then on the job
    can be claimed by others, and what the first worker settles is not taken any more.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.store = Store(spark, root, {"jobs": TABLE})
        self.spark = spark

    def add(self, ids: DataFrame) -> int:
        """Adds the jobs of ids(id) that the queue does not have, pending."""

        def change(now: Snapshot) -> Change:
            new = ids.select(F.col("id").cast("string")).distinct().join(now.table("jobs"), "id", "left_anti")
            none = F.lit(None).cast("string")
            return Change({"jobs": new.select("id", F.lit("pending").alias("state"), none.alias("worker"), none.alias("token"), F.lit(None).cast("double").alias("until"), none.alias("error"), F.lit(0).alias("tries"))})

        return self.store.update(change)

    def claim(self, worker: str, n: int, lease: float, now: float | None = None) -> tuple[str, list[str]]:
        """(token, ids) of up to n jobs, by id, that are the worker's for `lease` seconds; n bounds what reaches the driver."""
        token = uuid.uuid4().hex

        def change(seen: Snapshot) -> Change | None:
            at = time.time() if now is None else now
            free = (F.col("state") == "pending") | ((F.col("state") == "claimed") & (F.col("until") <= at))
            mine = stored(seen.table("jobs").where(free).orderBy("id").limit(n), "claim")
            if mine.isEmpty():
                return None
            return Change({"jobs": mine.withColumns({"state": F.lit("claimed"), "worker": F.lit(worker), "token": F.lit(token), "until": F.lit(at + lease).cast("double"), "tries": F.col("tries") + 1})})

        version = self.store.update(change)
        got = self.store.table("jobs", version).where(F.col("token") == token)
        return token, sorted(r.id for r in got.select("id").collect())

    def settle(self, token: str, results: DataFrame) -> int:
        """Jobs claimed under the token that are in results(id, error) are done, or failed where there is an error."""
        r = results.select(F.col("id").cast("string"), F.col("error").alias("e"))

        def change(seen: Snapshot) -> Change:
            mine = seen.table("jobs").where((F.col("token") == token) & (F.col("state") == "claimed")).join(r, "id")
            return Change({"jobs": mine.withColumn("state", F.when(F.col("e").isNull(), "done").otherwise("failed")).withColumn("error", F.col("e")).drop("e")})

        return self.store.update(change)

    def states(self) -> DataFrame:
        return self.store.table("jobs")
