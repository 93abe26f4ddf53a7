"""Host-level quality rules, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm._common import drop_stored, stored, words_of

MIN_WORDS = 50
#: A host is rejected if its shrunken failure rate, less its posterior deviations, is above this.
MAX_HOST_RATE = 0.6
DEVIATIONS = 2.0
SYMBOLS = r"[#*$%&|<>]"
#: The hash of the window at i.
HASH = "xxhash64(w[i], w[i + 1], w[i + 2])"
_WORDS = ("w[{0}]", "w[{0} + 1]", "w[{0} + 2]")
_PLACE = "cast({0} & (shiftleft(1L, b) - 1L) as int)"
_SAME = "shiftright(sorted[i], b) = shiftright(sorted[i + 1], b)"
#: Adds up the words that the windows at the sorted places {0} cover.
_COVER = """
aggregate({0}, named_struct('last', -9L, 'sum', 0L),
          (s, p) -> named_struct('last', p, 'sum', s.sum + least(3L, p - s.last)), s -> s.sum)
"""


def _windows() -> str:
    """SQL: a long for each window of w (n words), sorted: its hash above, its place in b bits."""
    return f"sort_array(transform(sequence(0, n - 3), i -> shiftleft(shiftright({HASH}, b), b) | cast(i as bigint)))"


def _collided() -> str:
    """SQL: whether two windows of one hash differ in a word. If none do, equal hashes mean equal windows."""
    p, q = _PLACE.format("sorted[i]"), _PLACE.format("sorted[i + 1]")
    words = " and ".join(f"{x.format(p)} = {x.format(q)}" for x in _WORDS)
    return f"exists(sequence(0, n - 4), i -> {_SAME} and not ({words}))"


def _repeated() -> str:
    """SQL: the words inside 3-word windows that occur twice or more, from sorted.

    Sorting puts windows of one hash side by side. Where hashes collide (texts under 4 million
    words leave 41 bits of one), the windows are sorted by their words instead.
    """
    twins = f"transform(sorted, (x, i) -> if((i > 0 and {_SAME.replace('i + 1', 'i - 1')}) or (i < n - 3 and {_SAME}), x & (shiftleft(1L, b) - 1L), -1L))"
    named = ", ".join(f"{x.format('i')} as {k}" for x, k in zip(_WORDS, "xyz", strict=True))
    by_words = f"sort_array(transform(sequence(0, n - 3), i -> struct({named}, cast(i as bigint) as at)))"
    same = " and ".join(f"u[i].{k} = u[{{0}}].{k}" for k in "xyz")
    exact = f"transform(u, (x, i) -> if((i > 0 and {same.format('i - 1')}) or (i < n - 3 and {same.format('i + 1')}), x.at, -1L))"
    # a lambda over an array of one element names the sorted windows, so that they are sorted once
    exact = f"transform(array({by_words}), u -> {exact})[0]"
    cover = [_COVER.format(f"sort_array(filter({places}, p -> p >= 0))") for places in (exact, twins)]
    return f"case when n < 4 then 0L when {_collided()} then {cover[0]} else {cover[1]} end"


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Null and empty texts have no words, so they fail. The names added must not occur in docs.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumns({"w": words_of(F.col(text_col)), "l": lines})
    df = df.withColumns(
        {
            "n": F.size("w"),
            "n_words": F.size("w").cast("long"),
            "word_chars": F.char_length(F.array_join("w", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("l") - F.size(F.array_distinct("l"))).cast("long"),
        }
    )
    df = df.withColumn("b", F.ceil(F.log2(F.greatest(F.col("n"), F.lit(2)).cast("double"))).cast("int") + 1)
    df = df.withColumn("sorted", F.when(F.col("n") >= 4, F.expr(_windows())))
    df = df.withColumn("n_repeat_words", F.expr(_repeated()))
    # a filter on base_failed must not move below the columns it needs: it would compute them once
    # for each of their uses, inside the lambdas too; one that is not deterministic stays
    df = df.withColumn("part", F.spark_partition_id())
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")) | (F.col("part") < 0))
    return df.drop("w", "l", "n", "b", "sorted", "part")


def host_verdicts(rows: DataFrame, max_rate: float = MAX_HOST_RATE, deviations: float = DEVIATIONS) -> DataFrame:
    """(host, host_docs, host_failed, host_rate, host_kept) from rows(host, base_failed).

    Failure rates are shrunk to a beta prior fitted to the hosts' rates by moments; one host
    alone, or hosts all alike, give a prior of strength 1000 or that of one document. A null
    host is a host of its own. Sums are formed before the shuffle, so a hot host costs no more.
    """
    hosts = rows.groupBy("host").agg(F.count("*").alias("host_docs"), F.count_if("base_failed").alias("host_failed"))
    p = F.col("host_failed") / F.col("host_docs")
    total = hosts.agg(F.sum("host_failed").alias("f"), F.sum("host_docs").alias("d"), F.var_samp(p).alias("v"))
    mean = F.try_divide(F.col("f").cast("double"), F.col("d"))
    spread = F.greatest(F.coalesce(F.col("v"), F.lit(0.0)), F.lit(1e-9))
    strength = F.least(F.greatest(F.col("m") * (1 - F.col("m")) / spread - 1, F.lit(1.0)), F.lit(1000.0))
    prior = total.select(mean.alias("m"), "v").select("m", strength.alias("s"))
    alpha, beta = F.col("m") * F.col("s") + F.col("host_failed"), (1 - F.col("m")) * F.col("s") + F.col("host_docs") - F.col("host_failed")
    rate = alpha / (alpha + beta)
    sd = F.sqrt(rate * (1 - rate) / (alpha + beta + 1))
    # the prior is one row, an aggregate without keys
    judged = hosts.join(F.broadcast(prior), F.lit(True))
    return judged.select("host", "host_docs", "host_failed", rate.alias("host_rate"), (rate - deviations * sd <= max_rate).alias("host_kept"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row a document: its measures, base_failed, its host's rate and the verdict kept.

    A document is kept if it passes the rules itself and its host does. Repeated rows and null
    ids are rows like others; an empty table gives an empty result; no other column is read.
    """
    rows = stored(measures(docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("_text")), "_text").drop("_text"), "rules")
    hosts = stored(host_verdicts(rows), "hosts")  # its size is known when the join below is planned
    out = rows.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).withColumnRenamed("host", host_col)


def keep(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that the rules keep, with their columns.

    The rules run once over all texts to judge the hosts and again over the texts of the hosts that
    stay, so what is stored is two columns a document and no text, and texts are not shuffled
    unless the rejected hosts outgrow a broadcast. Null and empty texts go; a null host is a host
    of its own; repeated rows and null ids are rows like others, and other columns may have any
    name; an empty table stays empty.
    """
    d = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text_col).alias("_text"), F.col(host_col).alias("host"))
    rows = stored(measures(d.select("_text", "host"), "_text").select("host", "base_failed"), "rules")
    # stored, so that its size is known when the join below is planned
    bad = stored(host_verdicts(rows).where(~F.col("host_kept")).select(F.col("host").alias("h")), "hosts")
    drop_stored(rows)
    stay = d.join(bad, F.col("host").eqNullSafe(F.col("h")), "left_anti")
    return measures(stay, "_text").where(~F.col("base_failed")).select("doc.*")
