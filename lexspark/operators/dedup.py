"""Exact and n-gram near-duplicate removal for ingestion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators.store import drop_stored, stored

THRESHOLD = 0.05
EVERY = 10
#: Words of a gram.
WORDS = 8
#: Rows of undecided documents that one task may take.
LAST_ROWS = 200_000


def exact(docs: DataFrame, digits: int = 64) -> DataFrame:
    """The first document, by id, of each content hash."""
    h = docs.select("doc_id", X.content_id(F.col("text"), digits).alias("content_id"))
    return h.groupBy("content_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def gram_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, i, g): every word 8-gram of a document, hashed."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.transform(X.grams(F.col("text")), lambda g: F.substring(F.sha2(g, 256), 1, 16))).alias("i", "g"))


def overlap(docs: DataFrame, index: DataFrame) -> DataFrame:
    """(id, hits, total): grams of each document that are among every 10th gram of the index."""
    known = gram_rows(index).where(F.col("i") % EVERY == 0).select("g").distinct().withColumn("hit", F.lit(1))
    return gram_rows(docs).join(known, "g", "left").groupBy("id").agg(F.count("hit").alias("hits"), F.count("*").alias("total"))


def greedy(docs: DataFrame, threshold: float = THRESHOLD, seed: DataFrame | None = None, order: str = "doc_id") -> DataFrame:
    """(order, accepted): by ascending order, a document goes if enough of its grams are indexed.

    Indexed are the grams of seed(g), and every 10th gram of each earlier document that is accepted.
    For a document it only matters whether the first accepted one that indexes a gram comes before
    it, so each gram has one such place, and is joined by it: documents are never paired, however
    many share a gram. Only grams that seed or an earlier document indexes are looked at; most
    documents are decided by their number alone. Of the others, in each round, one goes if the
    accepted ones alone index enough of its grams, and is accepted if even all open ones together
    index too few; the first open one is always decided. Once few rows are left, one task takes
    the rest in order, so that a long chain of documents does not need a round each.

    order must be a column of distinct numbers. Texts of fewer than eight words have no grams and
    are accepted. State is written to the shared folder.
    """
    code = lambda g: F.conv(g, 16, -10).cast("long").alias("g")
    rows = gram_rows(docs, order).select(F.col("id").alias("o"), code(F.col("g")), (F.col("i") % EVERY == 0).alias("s"))
    first = rows.where("s").groupBy("g").agg(F.min("o").alias("first"))
    near = rows.select("o", "g").join(first, "g", "left")
    seeded = F.lit(False)
    if seed is not None:
        near = near.join(seed.select(code(F.col("g"))).distinct().withColumn("known", F.lit(True)), "g", "left")
        seeded = F.coalesce("known", F.lit(False))
    # of all grams only those that seed or an earlier document indexes are kept
    near = near.withColumn("seeded", seeded).where(F.col("seeded") | F.coalesce(F.col("first") < F.col("o"), F.lit(False)))
    near = stored(near.groupBy("g", "o", "seeded").agg(F.count("*").alias("n")), "greedy-near")
    counts = near.groupBy("o").agg(F.sum(F.when(F.col("seeded"), F.col("n")).otherwise(0)).alias("low"), F.sum("n").alias("high"))
    total = F.nullif(F.greatest(F.size(X.words(F.col("text"))) - (WORDS - 1), F.lit(0)), F.lit(0)).cast("long")
    bar = F.lit(threshold) * F.col("total")
    verdict = F.when(F.col("total").isNull() | (F.coalesce("high", F.lit(0)) < bar), True).when(F.col("low") >= bar, False)
    state = stored(docs.select(F.col(order).alias("o"), total.alias("total")).join(counts, "o", "left").select("o", "total", verdict.alias("accepted")), "greedy")

    # what matters from here on: hits of open documents, and who indexes these grams
    hits = stored(near.join(state.where("accepted is null").select("o"), "o", "left_semi").select("o", "g", "n", "seeded"), "greedy-hits")
    drop_stored(near)
    by = stored(rows.where("s").select("o", "g").join(hits.select("g").distinct(), "g", "left_semi").distinct(), "greedy-by")
    while True:
        open_ = state.where("accepted is null").select("o", "total")
        if open_.isEmpty():
            break
        sure = by.join(state.where("accepted").select("o"), "o", "left_semi").groupBy("g").agg(F.min("o").alias("sure"))
        live = hits.join(open_, "o").join(sure, "g", "left").withColumn("low", F.col("seeded") | F.coalesce(F.col("sure") < F.col("o"), F.lit(False)))
        live = stored(live.select("o", "total", "g", "n", "low"), "greedy-live")
        own = by.join(open_.select("o"), "o", "left_semi")
        if live.count() + own.count() <= LAST_ROWS:
            decided = _in_order(live, own, threshold)
        else:
            able = own.groupBy("g").agg(F.min("o").alias("able"))
            n = live.join(able, "g", "left").groupBy("o", "total").agg(F.sum(F.when(F.col("low"), F.col("n")).otherwise(0)).alias("low"), F.sum(F.when(F.col("low") | (F.col("able") < F.col("o")), F.col("n")).otherwise(0)).alias("high"))
            decided = n.select("o", F.when(F.col("low") >= bar, False).when(F.col("high") < bar, True).alias("now"))
        after = stored(state.join(decided, "o", "left").select("o", "total", F.coalesce("accepted", "now").alias("accepted")), "greedy")
        for t in (state, live):
            drop_stored(t)
        state = after
    drop_stored(hits)
    drop_stored(by)
    return state.select(F.col("o").alias(order), "accepted")


def _in_order(live: DataFrame, own: DataFrame, threshold: float) -> DataFrame:
    """(o, now): the open documents decided one after the other, in a task; for LAST_ROWS rows at most."""

    def run(_: tuple, t: pd.DataFrame) -> pd.DataFrame:
        indexed: set[str] = set()
        out = []
        adds = t[t["total"].isna()].groupby("o")["g"].agg(list).to_dict()
        for o, x in t[t["total"].notna()].groupby("o"):  # ascending
            n = sum(k for g, k, low in zip(x["g"], x["n"], x["low"], strict=True) if low or g in indexed)
            out.append((o, not n >= threshold * x["total"].iloc[0]))
            if out[-1][1]:
                indexed.update(adds.get(o, ()))
        return pd.DataFrame(out, columns=["o", "now"])

    both = live.unionByName(own, allowMissingColumns=True)
    kind = live.schema["o"].dataType.simpleString()
    return both.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, f"o {kind}, now boolean")


def keep_first(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
