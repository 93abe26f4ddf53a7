"""Sharding over fixed virtual slots with a versioned slot-to-shard map."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.llm._common import shared_path, stored

SLOTS = 8192
#: Equal rows are numbered in so many cells, so that these do not meet in one task.
CELLS = 8


@dataclass(frozen=True)
class SlotMap:
    """shards[i] is the shard of virtual slot i; every edit makes a new version."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    @classmethod
    def initial(cls, n_shards: int, n_slots: int = SLOTS) -> SlotMap:
        return cls(0, n_shards, tuple(i % n_shards for i in range(n_slots)))

    def rebalanced(self, slot_bytes: dict[int, int], n_shards: int | None = None) -> SlotMap:
        """The next version: moves few slots, so that the shards' bytes come near equal.

        Shards above the mean give up their smallest slots until they are at it (slots of dropped
        shards all move); these go, largest first, to the shard with the fewest bytes.
        """
        n = n_shards or self.n_shards
        at = list(self.shards)
        load = [0] * n
        loose = []
        for i, s in enumerate(at):
            if s < n:
                load[s] += slot_bytes.get(i, 0)
            else:
                loose.append(i)
        mean = sum(slot_bytes.values()) / n
        by_shard: dict[int, list[int]] = {}
        for i, s in enumerate(at):
            if s < n and slot_bytes.get(i):
                by_shard.setdefault(s, []).append(i)
        for s, own in by_shard.items():
            for i in sorted(own, key=lambda i: (slot_bytes[i], i)):
                if load[s] <= mean:
                    break
                load[s] -= slot_bytes[i]
                loose.append(i)
        for i in sorted(loose, key=lambda i: (-slot_bytes.get(i, 0), i)):
            at[i] = min(range(n), key=lambda s: (load[s], s))
            load[at[i]] += slot_bytes.get(i, 0)
        return SlotMap(self.version + 1, n, tuple(at))

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the table of maps at path."""
        row = [(self.version, self.n_shards, json.dumps(self.shards))]
        spark.createDataFrame(row, "version int, n_shards int, shards string").write.mode("append").parquet(path)

    @classmethod
    def newest(cls, spark: SparkSession, path: str) -> SlotMap | None:
        """The newest version at path, or none if nothing was stored there."""
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return cls.load(spark, path) if there else None

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, by default the newest."""
        t = spark.read.parquet(path)
        r = (t.where(F.col("version") == version) if version is not None else t.orderBy(F.desc("version"))).first()
        return cls(r[0], r[1], tuple(json.loads(r[2])))


def shard(docs: DataFrame, n_shards: int = 8, maps: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, SlotMap]:
    """Every row's shard under law `bytes`, and the map that gave it.

    Rows are hashed by id and text checksum into fixed virtual slots; bytes are summed by slot
    (at most SLOTS sums reach the driver, whatever the input). The newest map of the table at
    maps (where there is none, the first one of all) is edited to even out the shards, stored
    there as the next version, read back and applied. `slot` numbers a shard's rows from 0 without
    gaps: by virtual slot, id and checksum, however the input is split.
    A null text counts no bytes (size 1, checksum 0); repeated rows and null ids are rows like
    others; an empty table gives an empty result; columns besides id and text are not read.
    """
    raw = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = rows.withColumn("virtual_slot", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text_crc32"), F.lit(SLOTS)).cast("int"))
    rows = stored(rows.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), "text_crc32", "size")).withColumn("cell", F.pmod(F.spark_partition_id(), F.lit(CELLS))), "sizes")

    spark = docs.sparkSession
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    maps = maps or shared_path(spark, "slot-maps")
    last = SlotMap.newest(spark, maps) or SlotMap.initial(n_shards)
    last.rebalanced({r.virtual_slot: r.b for r in sums}, n_shards).save(spark, maps)
    slot_map = SlotMap.load(spark, maps)

    before = [0] * n_shards
    starts = []
    for r in sorted(sums, key=lambda r: r.virtual_slot):
        s = slot_map.shards[r.virtual_slot]
        starts.append((r.virtual_slot, s, before[s]))
        before[s] += r.n
    starts_df = spark.createDataFrame(starts, "virtual_slot int, shard int, start long")
    # equal rows are counted by cell first; the counts, one row for all equal ones, are put in order
    runs = rows.groupBy("virtual_slot", "h", "cell").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("doc_id", "text_crc32", "size")])
    runs = runs.join(starts_df, "virtual_slot")
    in_slot = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "h", "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.select("virtual_slot", "h", "cell", "shard", (F.col("start") + F.sum("n").over(in_slot) - F.col("n")).alias("first"))
    own = Window.partitionBy("virtual_slot", "h", "cell").orderBy("doc_id", "text_crc32", "size")
    out = rows.withColumn("rn", F.row_number().over(own) - 1).join(runs, ["virtual_slot", "h", "cell"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("rn")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slot_map.version).alias("map_version")), slot_map
