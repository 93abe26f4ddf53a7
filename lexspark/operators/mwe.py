"""Multi-word expressions: adjacency, pointwise mutual information and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators import state, work
from lexspark.operators.store import hashed, sent, stored


def adjacency(tokens: DataFrame) -> DataFrame:
    """Each token with the next two of its document (w2, w3).

    Of tokens that have them (index.followed), as they are; else by a shuffle by document.
    """
    own = ["doc_id", "byte_offset", F.col("form").alias("w1")]
    if {"w2", "w3"} <= set(tokens.columns):
        return tokens.select(*own, "w2", "w3")
    w = Window.partitionBy("doc_id").orderBy("byte_offset")
    return tokens.select(*own, F.lead("form", 1).over(w).alias("w2"), F.lead("form", 2).over(w).alias("w3"))


def pmi(tokens: DataFrame, min_count: int = 10, min_pmi: float = 5.0, bigrams: bool = True, trigrams: bool = True) -> DataFrame:
    """(form, components, count, pmi): word pairs, and pairs around a hyphen, of high information.

    Both kinds are counted in one pass. A pair is no more frequent than its words, so only pairs of
    words that reach min_count are counted; these words are stored first, and their hashes sent to
    the tokens, which are not shuffled for them.
    """
    n = tokens.agg(F.count("*").alias("n"))
    uni = tokens.where(F.col("form").rlike(X.ASCII_LETTER)).groupBy("form").agg(F.count("*").alias("c"))
    a = adjacency(tokens).where(F.col("w1").rlike(X.ASCII_LETTER))
    both = F.array(*([F.struct(F.lit(2).alias("k"), F.col("w2").alias("w"))] * bigrams), *([F.struct(F.when(F.col("w2") == "-", 3).alias("k"), F.col("w3").alias("w"))] * trigrams))
    if not bigrams:
        a = a.where("w2 = '-'")
    pairs = a.select("w1", F.explode(both).alias("x")).select("w1", "x.k", F.col("x.w").alias("w2")).where("k is not null and w2 is not null").where(F.col("w2").rlike(X.ASCII_LETTER))
    if min_count > 1:
        uni = stored(uni.where(F.col("c") >= min_count), "words")
        often = uni.select(F.xxhash64("form").alias("_h"))
        pairs = hashed(hashed(pairs, ["w1"], often), ["w2"], often)
    counted = pairs.groupBy("w1", "w2", "k").agg(F.count("*").alias("count")).where(F.col("count") >= min_count)
    u1, u2 = uni.select(F.col("form").alias("w1"), F.col("c").alias("c1")), uni.select(F.col("form").alias("w2"), F.col("c").alias("c2"))
    # n is one row, an aggregate without keys
    joined = counted.join(u1, "w1").join(u2, "w2").join(F.broadcast(n), F.lit(True))
    value = F.log2("count") - F.log2("c1") - F.log2("c2") + F.log2("n")
    form = F.when(F.col("k") == 3, F.concat_ws("-", "w1", "w2")).when(F.instr("w2", "'") > 0, F.concat("w1", "w2")).otherwise(F.concat_ws(" ", "w1", "w2"))
    parts = F.when(F.col("k") == 3, F.array("w1", F.lit("-"), "w2")).otherwise(F.array("w1", "w2"))
    return joined.select(form.alias("form"), parts.alias("components"), "count", value.alias("pmi")).where(F.col("pmi") >= min_pmi)


def best_by_form(candidates: DataFrame) -> DataFrame:
    """Of candidates with one form, that of the highest PMI."""
    best = F.max_by(F.struct("components", "count", "pmi"), F.struct("pmi", "count", F.array_join("components", "\t")))
    return candidates.groupBy("form").agg(best.alias("b")).select("form", "b.*")


def find(tokens: DataFrame, wanted: DataFrame, lower: bool = False) -> DataFrame:
    """(form, doc_id, byte_offset) of all wanted(form, components) at once; two or three components.

    Tokens whose pair has no hash of a wanted one go before the join, so not all are shuffled for it.
    """
    own = (lambda c: F.lower(c)) if lower else (lambda c: c)
    x = adjacency(tokens)
    c = wanted.select("form", own(F.element_at("components", 1)).alias("a"), own(F.element_at("components", 2)).alias("b"), own(F.try_element_at("components", F.lit(3))).alias("c")).where(F.size("components").isin(2, 3))
    c = stored(c, "wanted")
    x, c = hashed(x, [own(F.col("w1")), own(F.col("w2"))], c.select(F.xxhash64("a", "b").alias("_h"))), sent(c)
    hit = (own(x["w1"]) == c["a"]) & (own(x["w2"]) == c["b"]) & (c["c"].isNull() | (own(x["w3"]) == c["c"]))
    return x.join(c, hit).select("form", "doc_id", "byte_offset")


def new_rows(found: DataFrame, index: DataFrame) -> DataFrame:
    """Found rows that the index does not hold."""
    return state.unchanged(found, index, state.KEY)


def without(candidates: DataFrame, *known: DataFrame) -> DataFrame:
    """Candidates whose form, in any case, is in none of the tables."""
    out = None
    for k in known:
        x = k.select(F.lower("form").alias("_k"))
        out = x if out is None else out.unionByName(x)
    return candidates.join(out.distinct(), F.lower("form") == F.col("_k"), "left_anti")


def first(queue: DataFrame, n: int = 20) -> DataFrame:
    """The first n entries of queue(form, components, pmi, count, seq), each form once."""
    return queue.groupBy("form").agg(F.min_by(F.struct("components", "pmi", "count", "seq"), "seq").alias("q")).select("form", "q.*").orderBy("seq", "form").limit(n)


def tasks(queue: DataFrame, found: DataFrame, docs: DataFrame, n: int = 20, most: int = 8, around: int = 150, seed: str = "tasks") -> DataFrame:
    """(form, task): review tasks as JSON for the first n entries of queue(form, components, pmi, count, seq), each form once.

    A task has up to `most` of the form's occurrences (found: form, doc_id, byte_offset), drawn by the
    seed, with around characters of text on each side of its surface form; its id follows from the
    form and the seed, so a task made again is the same. Entries of which no document is there are
    left out.
    """
    shown = work.uniform_sample(found.join(first(queue, n), "form"), ["form"], most, seed, ["doc_id", "byte_offset"])
    shown = stored(shown, "shown")  # few rows: the texts are not shuffled for them
    x = shown.join(docs.select("doc_id", "text"), "doc_id").where("text <> ''")
    near = X.context(F.col("text"), X.char_offset(F.col("text"), F.col("byte_offset")), X.surface(F.col("components")), around)
    per = x.groupBy("form", "components", "pmi", "count").agg(F.sort_array(F.collect_list(F.struct("rank", near.alias("context"), "doc_id", "byte_offset"))).alias("o"))
    refs = F.transform("o", lambda r: F.struct(r.doc_id.alias("doc_id"), r.byte_offset.alias("byte_offset")))
    key = F.substring(F.sha2(F.concat_ws("|", F.lit(seed), "form"), 256), 1, 32)
    task = F.struct(F.lit("mwe").alias("type"), key.alias("id"), "form", "components", "pmi", F.col("count").alias("corpus_count"), F.transform("o", lambda r: r.context).alias("contexts"), refs.alias("occurrence_refs"))
    return per.select("form", F.to_json(task).alias("task"))
