"""The occurrence index as a store: merged by document, read by form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators.index import tokenize
from lexspark.operators.store import stored
from lexspark.operators.versions import Change, Snapshot, Store, Table

#: Postings lie by prefix and, in ranges of (form, document), in files that know their forms: a
#: frequent form is several files, and a lookup opens those of its own range only.
TABLES = {
    "postings": Table(
        "form string, form_lower string, doc_id long, pos int, byte_offset long, batch string, prefix string",
        order=("prefix", "form_lower", "doc_id", "byte_offset"), partition="prefix", options=(("parquet.bloom.filter.enabled#form_lower", "true"), ("parquet.bloom.filter.expected.ndv#form_lower", "200000")),
    ),
    "docs": Table("doc_id long, batch string, content long", ("doc_id",)),
}


def opened(spark: SparkSession, root: str) -> Store:
    return Store(spark, root, TABLES)


def merge(store: Store, docs: DataFrame) -> int:
    """Indexes the documents(doc_id, text) that are new or whose text has changed; returns the version.

    The postings that a document had before are not read any more from that commit on. Documents
    that are there as they are change nothing; without any other there is no commit. Ids must not
    repeat; a row without an id is left out.
    """

    def change(now: Snapshot) -> Change | None:
        d = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("content"))
        new = stored(d.join(now.table("docs").select("doc_id", "content"), ["doc_id", "content"], "left_anti"), "unindexed")
        if new.isEmpty():
            return None
        batch = F.lit(uuid.uuid4().hex)
        t = tokenize(new).select("form", F.lower("form").alias("form_lower"), "doc_id", "pos", "byte_offset", batch.alias("batch"), X.prefix_of(F.col("form")).alias("prefix"))
        return Change({"postings": t, "docs": new.select("doc_id", batch.alias("batch"), "content")})

    return store.update(change)


def remove(store: Store, ids: DataFrame) -> int:
    """Takes the documents of ids(doc_id) out of the index."""
    return store.update(lambda now: Change(drop={"docs": ids}))


def live(now: Snapshot, rows: DataFrame | None = None) -> DataFrame:
    """Postings (or some of them) without those of documents that were indexed again or removed."""
    x = now.table("postings") if rows is None else rows
    return x.join(now.table("docs").select("doc_id", "batch"), ["doc_id", "batch"], "left_semi")


def lookup(now: Snapshot, form: str) -> DataFrame:
    """Postings of a form in any case: its prefix's folders, its range's files, its row groups."""
    first = form[:1].lower()
    prefix = first if "a" <= first <= "z" else "other"
    return live(now, now.table("postings").where((F.col("prefix") == prefix) & (F.col("form_lower") == form.lower())))


def compact(store: Store) -> int:
    """Writes the live postings anew as one part."""
    return store.update(lambda now: Change(whole={"postings": live(now)}))
