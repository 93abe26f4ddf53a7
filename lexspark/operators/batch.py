"""Request files for a batch service, their metadata, and ingest of what comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.operators.ranking import numbered
from lexspark.operators.store import sent, stored

#: Requests a file, the limit of hosted batch services.
PER_FILE = 50_000
KEY = ["form", "doc_id", "byte_offset"]


def requests(todo: DataFrame, senses: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """(custom_id, chunk, form, doc_id, byte_offset, request): one JSON request for each occurrence of a form with senses."""
    menu = senses.groupBy("form").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "definition"))), lambda x: x.definition).alias("senses"))
    menu = sent(stored(menu, "menus"))
    x = numbered(todo.select(*KEY).join(menu.select("form"), "form"), KEY, "custom_id").join(menu, "form")
    line = F.to_json(F.struct(F.concat(F.lit("r-"), F.col("custom_id")).alias("custom_id"), "form", "senses"))
    return x.select("custom_id", F.floor(F.col("custom_id") / per_file).alias("chunk"), *KEY, line.alias("request"))


def write(rows: DataFrame, path: str) -> None:
    """Paired files for each chunk: requests as JSON lines, and the metadata that ingest matches them by."""
    rows.select("chunk", F.col("request").alias("value")).repartition("chunk").write.mode("overwrite").partitionBy("chunk").text(f"{path}/requests")
    rows.select("chunk", "custom_id", *KEY).repartition("chunk").write.mode("overwrite").partitionBy("chunk").json(f"{path}/metadata")


def discover(replies: DataFrame, metadata: DataFrame) -> DataFrame:
    """(file, chunk) of each reply file: the one chunk whose ids hold the file's first id; none or several are an error.

    replies(file, custom_id); a row a file and a chunk, so both sides are small next to the replies.
    """
    first = replies.groupBy("file").agg(F.min("custom_id").alias("first"))
    span = metadata.groupBy("chunk").agg(F.min("custom_id").alias("lo"), F.max("custom_id").alias("hi"))
    hit = first.join(span, F.col("first").between(F.col("lo"), F.col("hi")), "left").groupBy("file").agg(F.count("chunk").alias("n"), F.min("chunk").alias("chunk"))
    one = F.when(F.col("n") == 1, F.col("chunk")).otherwise(F.raise_error(F.concat(F.lit("no single metadata file for "), F.col("file"))).cast("long"))
    return hit.select("file", one.alias("chunk"))


def parsed(body: Column) -> Column:
    """(sense, rating) of a reply, null where it is no such JSON."""
    return F.from_json(body, "sense int, rating int")


def outcomes(replies: DataFrame, metadata: DataFrame, senses: DataFrame) -> DataFrame:
    """replies(custom_id, body) with what each is about, its outcome, and the label it stands for.

    Outcomes: ok, malformed (no JSON, or a rating that is none), unknown id, unknown sense. Sense 0
    says that none fits and passes as the reserved key 0.
    """
    n = senses.groupBy("form").agg(F.max("position").alias("n_senses"))
    x = replies.join(metadata.select("custom_id", *KEY), "custom_id", "left").join(sent(stored(n, "senses")), "form", "left").withColumn("p", parsed(F.col("body")))
    sense = F.col("p.sense")
    outcome = (
        F.when(F.col("p").isNull() | sense.isNull() | F.col("p.rating").isNull() | ~F.col("p.rating").isin(0, 1, 2), "malformed")
        .when(F.col("form").isNull(), "unknown id").when((sense < 0) | (sense > F.coalesce("n_senses", F.lit(0))), "unknown sense").otherwise("ok")
    )
    key = F.when(sense == 0, "0").otherwise(F.concat_ws("#", "form", sense.cast("string")))
    return x.select("custom_id", *KEY, outcome.alias("outcome"), key.alias("sense_key"), F.col("p.rating").alias("rating"))


def labels(done: DataFrame) -> DataFrame:
    """The labels of the outcomes that are ok, ready for an upsert."""
    return done.where("outcome = 'ok'").select(*KEY, "sense_key", "rating")


def archive(like: DataFrame, paths: list[str], to: str) -> None:
    """Moves files that were ingested under the folder to."""
    spark = like.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(to).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(to))
    for p in paths:
        if not fs.rename(path(p), path(f"{to}/{p.rstrip('/').rsplit('/', 1)[1]}")):
            raise OSError(f"could not archive {p}")


