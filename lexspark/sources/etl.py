"""Ingestion in runs that can break off anywhere: pages to documents, both dedups, and the append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators import dedup
from lexspark.operators.ranking import numbered
from lexspark.operators.store import drop_stored, stored
from lexspark.operators.versions import Change, Snapshot, Store, Table
from lexspark.sources import readers

TABLES = {
    "staged": Table("origin string, no long, " + readers.PAGE),
    "corpus": Table("doc_id string, " + readers.PAGE),
    "grams": Table("g string"),
}


def opened(spark: SparkSession, root: str) -> Store:
    """The corpus at root: its documents, the grams that index them, the pages staged, and each source's cursor."""
    return Store(spark, root, TABLES)


def cursor(store: Store, source: str) -> int:
    """Pages of the source that earlier runs have taken."""
    return store.snapshot().marks.get(f"cursor:{source}", 0)


def stage(store: Store, source: readers.Source) -> int:
    """Reads and numbers the source's pages, by title and text, once for all runs; returns their number.

    They lie in order, so a run reads the row groups of its own pages only.
    """
    mark = f"staged:{source.name}"

    def change(now: Snapshot) -> Change | None:
        if mark in now.marks:
            return None
        pages = numbered(readers.read(store.spark, source), ["title", "text"], "no")  # reads what numbered() stored
        return Change({"staged": pages.withColumn("origin", F.lit(source.name)).sortWithinPartitions("no")}, marks={mark: pages.count()})

    store.update(change, [mark])
    return store.snapshot().marks[mark]


def _decided(now: Snapshot, docs: DataFrame) -> DataFrame:
    """docs(no, doc_id, text) that are the first of their content and new to the corpus, with accepted."""
    new = docs.groupBy("doc_id").agg(F.min_by(F.struct("no", "text"), "no").alias("d")).select("doc_id", "d.*")
    new = stored(new.join(now.table("corpus").select("doc_id"), "doc_id", "left_anti"), "new")
    return new.select("no").join(dedup.greedy(new, seed=now.table("grams"), order="no"), "no")


def augment(store: Store, source: readers.Source, n_docs: int = 10_000, n_pages: int | None = None) -> dict[str, int]:
    """Adds up to n_docs documents of the source's next n_pages pages (all that are left); returns counts.

    pages is the number of pages taken; of their documents new are added, exact have a text that
    the corpus or an earlier page has, near share enough word 8-grams with what was there or was
    added before, in the order of the pages (see dedup.greedy). With n_docs reached, the rest of
    the pages is left to the next run. Documents, their grams and the cursor are one commit: a run
    that breaks off, wherever, has done nothing, and one that another writer overtakes decides
    again on what that one has added.
    """
    total = stage(store, source)
    counts: dict[str, int] = {}

    def change(now: Snapshot) -> Change | None:
        done = now.marks.get(f"cursor:{source.name}", 0)
        end = total if n_pages is None else min(total, done + n_pages)
        pages = now.table("staged").where((F.col("origin") == source.name) & (F.col("no") >= done) & (F.col("no") < end)).drop("origin")
        docs = stored(readers.to_docs(pages, source.base_url), "docs")
        decided = stored(_decided(now, docs), "decided")
        accepted = decided.where("accepted").select("no")
        if accepted.count() > n_docs:
            end = numbered(accepted, ["no"], "place").where(F.col("place") == n_docs - 1).first()["no"] + 1
        own = decided.where(F.col("no") < end)
        fresh = stored(docs.join(own.where("accepted").select("no"), "no", "left_semi"), "fresh")
        new, seen = fresh.count(), own.count()
        counts.update(pages=end - done, new=new, near=seen - new, exact=docs.where(F.col("no") < end).count() - seen)
        grams = dedup.gram_rows(fresh, "no").where(F.col("i") % dedup.EVERY == 0).select("g").distinct().join(now.table("grams"), "g", "left_anti")
        drop_stored(docs)
        return Change({"corpus": fresh, "grams": grams}, marks={f"cursor:{source.name}": end}) if end > done else None

    store.update(change)
    return counts
