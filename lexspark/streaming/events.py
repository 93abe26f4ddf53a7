"""Event folders with Structured Streaming: draining one, and keeping labels up to date from one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.operators import state
from lexspark.operators.store import compact, sent, shared_path, stored
from lexspark.operators.versions import Change, Snapshot, Store, Table, replaced

EVENT = "event_id string, kind string, form string, doc_id long, byte_offset long, sense_key string, at long, seq long"
KINDS = ("upsert", "delete_by_sense", "delete_by_form")
ZSTD = (("compression", "zstd"),)
TABLES = {
    "seen": Table("event_id string, at long", ("event_id",), options=ZSTD),
    "upserts": Table("form string, doc_id long, byte_offset long, sense_key string, at long, seq long", tuple(state.KEY), options=ZSTD),
    "by_sense": Table("sense_key string, at long, seq long", ("sense_key",)),
    "by_form": Table("form string, at long, seq long", ("form",)),
    "labels": Table("form string, doc_id long, byte_offset long, sense_key string", tuple(state.KEY)),
    "counts": Table("sense_key string, n long", ("sense_key",)),
    "dead": Table(EVENT + ", reason string"),
}


def drain(spark: SparkSession, path: str, every: str | None = None, to: str | None = None) -> DataFrame:
    """Applies all events at path that were not applied before, and returns those applied.

    Each micro-batch goes to its own folder, so one that is repeated after a failure replaces
    what it wrote; rows without id or kind go to a dead-letter folder. With every, the queue is
    watched at that interval instead, until the query is stopped.
    """
    to = to or shared_path(spark, "drain")
    schema = spark.read.parquet(path).schema

    def apply(batch: DataFrame, epoch: int) -> None:
        good = F.col("event_id").isNotNull() & F.col("event_type").isNotNull()
        batch.where(good).write.mode("overwrite").parquet(f"{to}/done/epoch={epoch}")
        batch.where(~good).write.mode("overwrite").parquet(f"{to}/failed/epoch={epoch}")

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        source, path = source.option("pathGlobFilter", at.getName()), str(at.getParent())
    stream = source.parquet(path).writeStream.foreachBatch(apply).option("checkpointLocation", f"{to}/offsets")
    q = (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()
    if not every:
        q.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{to}/done")


def _later(last: DataFrame, key: list[str], old: DataFrame) -> DataFrame:
    """The rows of last, one a key, where old has no later one, by at and seq."""
    before = old.select(*key, F.struct("at", "seq").alias("_o"))
    return last.join(before, key, "left").where("_o is null or _o < struct(at, seq)").select(*old.columns)


def _newest(rows: DataFrame, key: list[str], old: DataFrame) -> DataFrame:
    """The last event of each key, by at and seq, where old has no later one."""
    return _later(rows.groupBy(*key).agg(F.max_by(F.struct(*old.columns), F.struct("at", "seq")).alias("e")).select("e.*"), key, old)


def _last_upserts(rows: DataFrame, old: DataFrame) -> DataFrame:
    """_newest() of upserts, which are dealt out by place, unsorted, and sorted there once; of several at once that of the greatest sense key."""
    w = Window.partitionBy("doc_id", "_area", "byte_offset", "form").orderBy(F.desc("at"), F.desc("seq"), F.desc("sense_key"))
    return _later(state.near(rows.select(*old.columns)).withColumn("_n", F.row_number().over(w)).where("_n = 1"), state.KEY, old)


#: Hashes that a task packs at a time.
PACKED = 1 << 21


def _packed(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hashes as rows of (bucket, hashes), made of most at a time: 14 bits of each are the bucket, and the next 32 stand in its array."""

    def rows(h: list[np.ndarray]) -> pa.RecordBatch:
        x = np.sort(np.concatenate(h).view(np.uint64))
        b, first = np.unique((x >> np.uint64(50)).astype(np.int32), return_index=True)
        ends = pa.array(np.append(first, len(x)), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(b), pa.ListArray.from_arrays(ends, pa.array((x >> np.uint64(18)).astype(np.uint32).view(np.int32)))], ["b", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, n = [], 0
        for x in batches:
            some.append(x.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            n += len(some[-1])
            if n >= most:
                yield rows(some)
                some, n = [], 0
        if n:
            yield rows(some)

    return run


def _hash(x: DataFrame) -> DataFrame:
    """x with _b and _v, the 46 bits of an event's id that _packed() keeps."""
    h = F.xxhash64("event_id")
    return x.withColumns({"_b": F.shiftrightunsigned(h, 50).cast("int"), "_v": F.shiftright(F.shiftleft(h, 14), 32).cast("int")})


def _unrepeated(x: DataFrame, seen: DataFrame) -> DataFrame:
    """The events of x, one of each id, whose id is not in seen.

    Only hashes of the ids are shuffled, four bytes each. Ids are compared themselves where a hash
    comes twice; all other events are as they are in the files of x, which are read again.
    """
    ids = x.select(F.xxhash64("event_id").alias("h")).unionByName(seen.select(F.xxhash64("event_id").alias("h")))
    h = ids.mapInArrow(_packed(PACKED), "b int, v array<int>").repartition("b").select("b", F.explode("v").alias("v"))
    twice = stored(h.groupBy(F.col("b").alias("_b"), F.col("v").alias("_v")).agg(F.count("*").alias("n")).where("n > 1").select("_b", "_v"), "twice")
    if twice.isEmpty():
        return x
    x, twice = _hash(x), sent(twice)
    more = x.join(twice, ["_b", "_v"], "left_semi").drop("_b", "_v").dropDuplicates(["event_id"]).join(seen.select("event_id"), "event_id", "left_anti")
    return x.join(twice, ["_b", "_v"], "left_anti").drop("_b", "_v").unionByName(stored(more, "events"))


def applied(now: Snapshot, batch: DataFrame, delay: int | None = None) -> Change:
    """What a batch of events (EVENT) changes in the tables of a label store.

    The last upsert of an occurrence stands, unless a later delete names its form or sense; so the
    labels depend on the events alone, not on the order or the batches in which they come.
    An event whose id was seen is dropped. One without id, of an unknown kind or without time goes
    to `dead`, as does one that is more than delay behind the latest of the batches before; ids
    older than that are forgotten. counts has the labels of each sense, added up from changes.
    """
    latest = now.marks.get("latest")
    bound = None if delay is None or latest is None else latest - delay
    order = F.struct("at", "seq")
    bad = F.when(F.col("event_id").isNull() | ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)) | F.col("at").isNull(), "malformed")
    late = bad if bound is None else bad.when(F.col("at") < bound, "late")
    x = batch.withColumn("reason", late)
    good = _unrepeated(x.where("reason is null").withColumn("seq", F.coalesce("seq", F.lit(0))), now.table("seen"))

    upserts = compact(_last_upserts(good.where("kind = 'upsert'"), now.table("upserts")), "upserts")
    by_sense = stored(_newest(good.where("kind = 'delete_by_sense' and sense_key is not null"), ["sense_key"], now.table("by_sense")), "by-sense")
    by_form = stored(_newest(good.where("kind = 'delete_by_form' and form is not null"), ["form"], now.table("by_form")), "by-form")

    # the occurrences whose label may differ now: those put, and those that a delete may reach
    begins = not now.commit.parts.get("upserts")
    every = upserts if begins else state.upsert(now.table("upserts"), upserts, state.KEY)
    reach = every.join(by_sense.select("sense_key"), "sense_key", "left_semi").select(*state.KEY).unionByName(every.join(by_form.select("form"), "form", "left_semi").select(*state.KEY))
    touched = upserts.select(*state.KEY) if begins else stored(reach.unionByName(upserts.select(*state.KEY)).distinct(), "touched")
    deleted = lambda t, new, c: sent(new) if not now.commit.parts.get(t) else state.upsert(now.table(t), new, [c])
    gone = {c: deleted(t, new, c).select(c, order.alias(f"{c}_gone")) for c, t, new in (("sense_key", "by_sense", by_sense), ("form", "by_form", by_form))}
    own = every if begins else every.join(touched, state.KEY, "left_semi")
    own = own.join(gone["sense_key"], "sense_key", "left").join(gone["form"], "form", "left")
    live = own.where("(sense_key_gone is null or struct(at, seq) > sense_key_gone) and (form_gone is null or struct(at, seq) > form_gone)").select(*state.KEY, "sense_key")
    old = now.table("labels").join(touched, state.KEY, "left_semi")
    put, drop = (live, old.select(*state.KEY)) if begins else replaced(old, live, state.KEY)
    lost = old.join(put.select(*state.KEY).unionByName(drop), state.KEY, "left_semi").select("sense_key", F.lit(-1).alias("n"))
    more = lost.unionByName(put.select("sense_key", F.lit(1).alias("n"))).groupBy("sense_key").agg(F.sum("n").alias("d")).where("d <> 0")
    counts = more.join(now.table("counts"), "sense_key", "left").select("sense_key", (F.coalesce("n", F.lit(0)) + F.col("d")).alias("n"))

    newest = good.agg(F.max("at")).first()[0]
    newest = max((v for v in (newest, latest) if v is not None), default=None)
    change = Change({"seen": good.select("event_id", "at"), "upserts": upserts, "by_sense": by_sense, "by_form": by_form, "labels": put, "counts": counts.where("n > 0"), "dead": x.where("reason is not null")}, {"labels": drop, "counts": counts.where("n = 0")}, distinct=frozenset(TABLES))
    if delay is not None and newest is not None:
        change.drop["seen"] = now.table("seen").where(F.col("at") < newest - delay)
    change.marks = {"latest": newest}
    return change


def follow(spark: SparkSession, path: str, root: str, delay: int | None = None, every: str | None = None, files: int = 1000) -> Store:
    """Keeps the label store at root up to date from the event files (Parquet, EVENT) that come to the folder path.

    Without `every`, what is there is applied and the store returned; with it, the folder is
    watched at that interval until the query is stopped. A micro-batch is one commit, with its
    number as a mark, so one that is repeated after a failure is not applied again.
    """
    store = Store(spark, root, TABLES)

    def apply(batch: DataFrame, epoch: int) -> None:
        store.update(lambda now: None if now.marks.get("epoch", -1) >= epoch else _marked(applied(now, batch, delay), epoch))

    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).parquet(path).writeStream.foreachBatch(apply).option("checkpointLocation", f"{root}/_offsets")
    q = (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()
    if not every:
        q.awaitTermination()
    return store


def _marked(change: Change, epoch: int) -> Change:
    change.marks["epoch"] = epoch
    return change
