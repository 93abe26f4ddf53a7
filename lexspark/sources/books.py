"""Books listed in an archive of RDF descriptions, and dumps kept in a cache folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.sources.readers import Source, strip_book

# fixed values: the namespaces of the public format
RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
TERMS = "{http://purl.org/dc/terms/}"
BOOK = "{http://www.gutenberg.org/2009/pgterms/}"
# fixed values: the marks around a book's text
START, END = "*** START OF THE PROJECT GUTENBERG EBOOK", "*** END OF THE PROJECT GUTENBERG EBOOK"

ENTRY = "about string, language string, type string, media array<string>, title string, author string"


def described(xml: bytes) -> dict | None:
    """An ENTRY from one description; None if it cannot be read or describes no book.

    Of languages and types, and of the media types of each format, the first counts.
    """
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return None
    book = next((e for e in root if e.tag in (f"{BOOK}ebook", f"{RDF}Description") and e.find(f"{TERMS}hasFormat") is not None), None)
    if book is None:
        return None
    value = lambda e, tag: e.findtext(f".//{TERMS}{tag}//{RDF}value")
    media = [m for f in book.iter(f"{TERMS}hasFormat") if (m := value(f, "format"))]
    return {"about": book.get(f"{RDF}about"), "language": value(book, "language"), "type": value(book, "type"), "media": media, "title": book.findtext(f"{TERMS}title"), "author": book.findtext(f".//{BOOK}agent/{BOOK}name")}


#: What every description ends with, whatever its prefix is called.
CLOSE = ":RDF>"


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """ENTRY rows of the .rdf members of tar archives, plain or compressed.

    The members of an archive are XML that ends alike, so it is read as text cut after that: a
    plain or bzip2 archive is as many tasks as it has splits, and no task holds more than a member.
    What stands before the last description that opens is the archive's header with the member's
    name, fill, and what may be left of a broken member before it.
    """
    members = spark.read.option("lineSep", CLOSE).text(path)
    parts = members.select(F.regexp_extract("value", r"(?s)^(.*)<[\w.-]+:RDF\s", 1).alias("head"), F.regexp_extract("value", r"(?s)^.*(<[\w.-]+:RDF\s.*)$", 1).alias("xml"))
    named = parts.where(F.col("xml").rlike(r"</[\w.-]+$")).where(F.contains("head", F.lit(".rdf")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ENTRY.split(", ")]
        for b in batches:
            yield pd.DataFrame([e for x in b.xml if (e := described((x + CLOSE).encode()))], columns=names)

    return named.select("xml").mapInPandas(run, ENTRY)


def read_books(spark: SparkSession, source: Source, fetch: Callable[[str], str | None], language: str = "en") -> DataFrame:
    """Pages (readers.PAGE) of the catalogue's books in the language that have a plain text.

    fetch gives a book's text by its number, or None; it runs in the tasks, and books without a
    text are left out. A book without a title is named by its number; there is no year.
    """
    plain = F.exists("media", lambda m: m.contains("text/plain"))
    x = read_catalogue(spark, source.path).withColumn("id", F.regexp_extract(F.coalesce("about", F.lit("")), r"/(\d+)$", 1))
    x = x.where((F.col("language") == language) & (F.col("type") == "Text") & plain & (F.col("id") != ""))
    x = x.select("id", F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Book #"), "id")).alias("title"), "author")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(len(b)):  # a book at a time: texts are long
                one = b.iloc[i : i + 1]
                if text := fetch(one.id.iloc[0]):
                    yield one.assign(text=text)

    # a gzip archive comes through one task: fetching is spread over all
    got = x.repartition("id").mapInPandas(run, "id string, title string, author string, text string")
    pages = got.withColumn("text", strip_book(F.col("text"), START, END)).where("text <> ''")
    return pages.select("title", "text", F.lit(None).cast("int").alias("year"), "author", F.lit(source.name).alias("source"), F.concat(F.lit(source.base_url), "id").alias("source_url"))


def cached(spark: SparkSession, url: str, path: str, fetch: Callable[[str], Iterable[bytes]]) -> str:
    """path, after fetching the url's bytes to it unless it is there; a broken fetch leaves no such file."""
    jvm = spark.sparkContext._jvm
    to, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(to):
        out = fs.create(part, True)
        try:
            for chunk in fetch(url):
                out.write(bytearray(chunk))
        finally:
            out.close()
        fs.rename(part, to)
    return path
