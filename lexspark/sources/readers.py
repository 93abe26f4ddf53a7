"""Page sources: wiki dumps, hub tables, JSON lines, plain books."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators.store import drop_stored, stored

#: Only what is used of a dump's page; an explicit schema spares a pass over the file.
DUMP = "title string, ns int, redirect struct<_title:string>, revision struct<timestamp:string, contributor:struct<username:string>, text:struct<_VALUE:string>>"
PAGE = "title string, text string, year int, author string, source string, source_url string"
MIN_CHARS = 200


@dataclass(frozen=True)
class Source:
    """Where pages come from: kind (wiki, hub or jsonl), path, and the base of their URLs."""

    name: str
    kind: str
    path: str
    base_url: str = ""


def read_dump(spark: SparkSession, source: Source) -> DataFrame:
    """Articles of a MediaWiki dump (.xml or .xml.bz2): main namespace, no redirects, with text.

    Namespaces of the XML are ignored. The year is the revision's, unless the page's header
    template gives one.
    """
    raw = spark.read.format("xml").option("rowTag", "page").option("ignoreNamespace", "true").option("valueTag", "_VALUE").schema(DUMP).load(source.path)
    text = F.col("revision.text._VALUE")
    ok = (F.col("ns") == 0) & F.col("redirect").isNull() & (F.col("title") != "") & (text != "")
    return raw.where(ok).select(
        "title", text.alias("text"), X.year_of(F.col("revision.timestamp"), text).alias("year"), F.col("revision.contributor.username").alias("author"), F.lit(source.name).alias("source"), F.lit(None).cast("string").alias("source_url")
    )


def read_hub(spark: SparkSession, source: Source) -> DataFrame:
    """Rows of a published table with a text; the year is that of its date."""
    raw = spark.read.parquet(source.path)
    col = lambda c: F.col(c).cast("string") if c in raw.columns else F.lit(None).cast("string")
    return raw.where(F.trim(F.coalesce(col("text"), F.lit(""))) != "").select(F.coalesce(col("title"), F.lit("")).alias("title"), col("text").alias("text"), X.year_of(col("date")).alias("year"), col("author").alias("author"), F.lit(source.name).alias("source"), col("url").alias("source_url"))


def read_jsonl(spark: SparkSession, source: Source) -> DataFrame:
    return spark.read.schema(PAGE).json(source.path)


READERS: dict[str, Callable[[SparkSession, Source], DataFrame]] = {"wiki": read_dump, "hub": read_hub, "jsonl": read_jsonl}


def read(spark: SparkSession, source: Source) -> DataFrame:
    """Pages of a source; an unknown kind is an error."""
    if source.kind not in READERS:
        raise ValueError(f"unknown kind of source: {source.kind}")
    return READERS[source.kind](spark, source)


def write_jsonl(pages: DataFrame, path: str) -> None:
    pages.write.mode("append").json(path)


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def strip_markup(text: Column) -> Column:
    """Plain text of simple wiki markup: templates, links, emphasis, tags, headings, comments."""
    x = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    x = F.regexp_replace(x, r"(?s)<ref[^>/]*/>|<ref[^>]*>.*?</ref>", "")
    for _ in range(3):  # templates inside templates
        x = F.regexp_replace(x, r"\{\{[^{}]*\}\}", "")
    x = F.regexp_replace(x, r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", "$1")
    x = F.regexp_replace(x, r"\[https?://\S+ ?([^\]]*)\]", "$1")
    x = F.regexp_replace(x, r"(?m)^=+ *(.*?) *=+ *$", "$1")
    return _strip(F.regexp_replace(F.regexp_replace(x, "'{2,5}", ""), r"<[^>]+>", ""))


def strip_book(text: Column, start: str, end: str) -> Column:
    """A book's text after the line with the start mark and before the end mark, as far as there are such."""
    at = F.locate(start, text)
    body = F.transform(F.array(F.struct(text.alias("t"), at.alias("a"))), lambda s: F.when(s.a > 0, F.regexp_replace(F.substring(s.t, s.a, F.char_length(s.t)), r"^[^\n]*\n?", "")).otherwise(s.t))
    cut = F.transform(body, lambda b: F.when(F.locate(end, b) > 0, F.substring(b, F.lit(1), F.locate(end, b) - 1)).otherwise(b))
    return _strip(F.element_at(cut, 1))


def to_docs(pages: DataFrame, base_url: str, markup: bool = True, digits: int = 64) -> DataFrame:
    """Documents of pages: stripped text of at least MIN_CHARS characters, content id and URL."""
    text = strip_markup(F.col("text")) if markup else _strip(F.col("text"))
    docs = pages.withColumn("text", text).where(F.char_length("text") >= MIN_CHARS)
    return docs.withColumn("doc_id", X.content_id(F.col("text"), digits)).withColumn("source_url", X.source_url(F.col("source_url"), F.lit(base_url), F.col("title")))


def append(docs: DataFrame, path: str) -> int:
    """Adds the documents that the corpus at path lacks, one of each id; returns their number."""
    spark = docs.sparkSession
    new = docs.dropDuplicates(["doc_id"])
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        new = new.join(spark.read.parquet(path).select("doc_id"), "doc_id", "left_anti")
    new = stored(new, "append")
    new.write.mode("append").parquet(path)
    n = new.count()
    drop_stored(new)
    return n
