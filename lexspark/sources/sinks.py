"""Lists, shards, item files, logs and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators.ranking import numbered
from lexspark.operators.store import stored
from lexspark.operators.versions import Change, Store, Table


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_list(spark: SparkSession, path: str, schema: str = "form string") -> DataFrame:
    """A control list (queue, blocklist, skipped forms): as write_list() left it, or JSON lines; one that was never written is empty."""
    if _exists(spark, f"{path}/_commits"):
        return Store(spark, path, {"list": Table(schema)}).table("list")
    return spark.read.schema(schema).json(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def write_list(rows: DataFrame, path: str, order: list[str]) -> None:
    """The list in order, as the next version of what is at path: readers see the old one or the new one, whatever fails."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    store = Store(rows.sparkSession, path, {"list": Table(schema)})
    kept = stored(rows, "list")  # rows may come from the version that goes
    store.update(lambda now: Change(whole={"list": kept.orderBy(*order).coalesce(1)}))
    store.clean(2)


def write_shards(rows: DataFrame, path: str, order: list[str], size: int) -> None:
    """Contiguous runs of size rows in order, each a folder shard=n."""
    x = numbered(rows, order, "_n").withColumn("shard", F.floor(F.col("_n") / size)).drop("_n")
    x.repartition("shard").sortWithinPartitions("shard", *order).write.mode("overwrite").partitionBy("shard").parquet(path)


def write_items(rows: DataFrame, path: str, name: str) -> None:
    """One JSON folder for each item, by its quoted name; for small sets of tasks and viewer entries."""
    rows.withColumn("item", F.url_encode(name)).repartition("item").write.mode("overwrite").partitionBy("item").json(path)


def append_log(rows: DataFrame, path: str, at: str) -> None:
    """Adds rows to an event log by month, all stamped with one time."""
    stamp = F.lit(at).cast("timestamp")
    rows.withColumn("at", stamp).withColumn("month", F.date_format(stamp, "yyyy-MM")).write.mode("append").partitionBy("month").json(path)


def bucket(form: Column) -> Column:
    """The first letter and the first two of a form; `special` where it does not begin with a-z."""
    low = F.lower(form)
    return F.when(low.rlike("^[a-z]"), F.concat_ws("/", F.substring(low, 1, 1), F.substring(low, 1, 2))).otherwise("special")


def write_export(rows: DataFrame, path: str, form: str = "form") -> None:
    """Rows by bucket of the form, sorted by it, without null fields."""
    rows.withColumn("bucket", bucket(F.col(form))).repartition("bucket").sortWithinPartitions("bucket", form).write.mode("overwrite").option("ignoreNullFields", "true").partitionBy("bucket").json(path)


def merged(*parts: DataFrame, key: str = "form", order: str = "updated_at") -> DataFrame:
    """Compiled parts as one; of entries with one key the newest stands."""
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    return x.groupBy(key).agg(F.max_by(F.struct(*x.columns), F.struct(order, F.xxhash64(*x.columns))).alias("e")).select("e.*")


def log_new(events: DataFrame, path: str, key: str = "id", at: str = "created_at") -> None:
    """Adds the events that the log at path lacks, by month of their time (`unknown` for none), in order of it."""
    spark = events.sparkSession
    new = events.dropDuplicates([key])
    if _exists(spark, path):
        logged = spark.read.schema(new.select(key).schema).json(path)
        new = new.join(logged, key, "left_anti")
    new = new.withColumn("month", F.coalesce(F.date_format(at, "yyyy-MM"), F.lit("unknown")))
    new.repartition("month").sortWithinPartitions("month", at, key).write.mode("append").partitionBy("month").json(path)


def copy_files(spark: SparkSession, paths: list[str], to: str) -> None:
    """Copies files or folders under the folder to, over what is there; those that do not exist are left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = jvm.org.apache.hadoop.fs.Path(to)
    there.getFileSystem(conf).mkdirs(there)
    for path in paths:
        src = jvm.org.apache.hadoop.fs.Path(path)
        if _exists(spark, path):
            dst = jvm.org.apache.hadoop.fs.Path(there, src.getName())
            dst.getFileSystem(conf).delete(dst, True)
            jvm.org.apache.hadoop.fs.FileUtil.copy(src.getFileSystem(conf), src, dst.getFileSystem(conf), dst, False, conf)


def backup(entries: DataFrame, path: str, events: DataFrame | None = None, lists: list[str] | None = None) -> None:
    """Entries by letter and digraph, the new change events, and copies of the control lists, under path."""
    write_export(entries, f"{path}/entries")
    if events is not None:
        log_new(events, f"{path}/mutations")
    copy_files(entries.sparkSession, lists or [], f"{path}/lists")
