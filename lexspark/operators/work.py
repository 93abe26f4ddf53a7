"""Selection of work: weights, samples, allocation, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators.ranking import numbered, running
from lexspark.operators.store import sent, stored


def need(totals: DataFrame, counts: DataFrame, alpha: float = 5.0) -> DataFrame:
    """totals(form, total) with bad_rate and need_work from counts(form, n_labeled, n_covered)."""
    x = totals.join(counts, "form", "left").withColumns({"n_labeled": F.coalesce("n_labeled", F.lit(0)), "n_covered": F.coalesce("n_covered", F.lit(0))})
    rate = F.when(F.col("n_labeled") + alpha > 0, (F.col("n_labeled") - F.col("n_covered") + alpha) / (F.col("n_labeled") + alpha)).otherwise(1.0)
    return x.withColumn("bad_rate", rate).withColumn("need_work", F.col("total") * F.col("bad_rate"))


def weighted_sample(rows: DataFrame, weight: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows drawn without replacement in proportion to the weight, in draw order; the seed fixes it."""
    e = -F.ln(X.unit_hash(F.lit(seed), F.col(key))) / F.col(weight)
    return rows.where(F.col(weight) > 0).withColumn("draw", e).orderBy("draw", key).limit(n)


def _sizes(rows: DataFrame, group: list[str], k: Column | int | None = None) -> DataFrame:
    """The groups with their number of rows (_n) and k (_most), stored."""
    most = [F.max(F.lit(k) if isinstance(k, int) else k).cast("long").alias("_most")] if k is not None else []
    return stored(rows.groupBy(*group).agg(F.count("*").alias("_n"), *most), "groups")


def _on(a: DataFrame, b: DataFrame, group: list[str]) -> Column:
    out = F.lit(True)
    for c in group:
        out = out & a[c].eqNullSafe(b[f"_{c}"])
    return out


def _first(rows: DataFrame, group: list[str], k: Column | int, seed: str, key: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """The first k rows of each group by the hash of seed and key, with their rank; k may be a column of the group.

    A group's size says below which hash its first k rows lie almost surely, so few others are
    shuffled and ranked, however frequent the group. What came is counted: of a group with too few
    below its bound all rows are taken. sizes(group, _n, _most) are those of _sizes(), of the groups that
    are wanted.
    """
    draw = F.md5(F.concat_ws("|", F.lit(seed), *key))
    sizes = _sizes(rows, group, k) if sizes is None else sizes
    most = F.coalesce("_most", F.lit(0))
    share = (most + 6 * F.sqrt(most) + 20) / F.col("_n")
    bound = F.when(share >= 1, "g").otherwise(F.lower(F.lpad(F.hex(F.floor(share * 2**32).cast("long")), 8, "0")))
    limits = sent(sizes).select(*[F.col(c).alias(f"_{c}") for c in group], bound.alias("_bound"))
    few = stored(rows.join(limits, _on(rows, limits, group)).where(draw < F.col("_bound")).select(*rows.columns), "drawn")
    got = few.groupBy(*[F.col(c).alias(f"_{c}") for c in group]).agg(F.count("*").alias("_got"))
    short = sizes.join(got, _on(sizes, got, group), "left").where(F.coalesce("_got", F.lit(0)) < F.least("_most", "_n"))
    short = stored(short.select(*[F.col(c).alias(f"_{c}") for c in group]), "short")
    if not short.isEmpty():
        few = few.join(short, _on(few, short, group), "left_anti").unionByName(rows.join(short, _on(rows, short, group), "left_semi"))
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(draw, *key))).where(F.col("rank") <= k)


def uniform_sample(rows: DataFrame, group: list[str], k: int, seed: str, key: list[str]) -> DataFrame:
    """Up to k rows of each group, by the hash of seed and key."""
    return _first(rows, group, k, seed, key)


def allocate(rows: DataFrame, budget: int) -> DataFrame:
    """rows(form, weight, avail) with n: the budget shared by weight, capped by what is available.

    Forms are filled in order of avail / weight until one takes its share of what is left; from
    there on none is capped. The order is total; what is filled before a form and what weighs
    after it are running sums over ranges of it (see ranking.running).
    """
    q = F.col("avail") / F.col("weight")
    x = rows.where("weight > 0 and avail > 0").select("form", "weight", "avail", F.lit(1).alias("one"))
    x = running(x, [q, "form"], {"filled": "avail", "place": "one"})
    x = running(x, [q.desc(), F.col("form").desc()], {"rest": "weight"})
    x = stored(x.withColumn("before", F.col("filled") - F.col("avail")).withColumn("share", (budget - F.col("before")) * F.col("weight") / F.col("rest")), "shares")
    at = x.where(F.col("share") < F.col("avail")).agg(F.min(F.struct("place", "before", "rest")).alias("s"))
    y = x.join(F.broadcast(at), F.lit(True), "left")  # one row
    n = F.when(F.col("place") >= F.col("s.place"), ((budget - F.col("s.before")) * F.col("weight") / F.col("s.rest")).cast("long")).otherwise(F.col("avail"))
    return y.select("form", n.cast("long").alias("n")).where("n > 0")


def sense_weights(senses: DataFrame, counts: DataFrame) -> DataFrame:
    """(form, weight): the sum of 1 / sqrt(n + 1) over the senses that a form's menu draws on.

    These are the senses of all its case variants, and for each variant whose senses name exactly
    one base form those of the base. counts(form, sense_key, n) has the good labels of each sense.
    Sums by form are made once and added up by lower-cased form, so variants are not paired.
    """
    n = counts.select("form", F.col("sense_key").alias("id"), "n")
    x = senses.select("form", "id", "morph_base").join(n, ["form", "id"], "left")
    base = F.when(F.min("morph_base") == F.max("morph_base"), F.min("morph_base"))
    own = x.groupBy("form").agg(F.sum(1 / F.sqrt(F.coalesce("n", F.lit(0)) + 1)).alias("own"), base.alias("base"))
    of_base = own.select(F.col("form").alias("base"), F.col("own").alias("more"))
    full = own.join(of_base, "base", "left").select("form", F.lower("form").alias("key"), (F.col("own") + F.coalesce("more", F.lit(0.0))).alias("w"))
    return full.select("form", "key").join(full.groupBy("key").agg(F.sum("w").alias("weight")), "key").select("form", "weight")


def stale_split(labels: DataFrame, latest: DataFrame) -> DataFrame:
    """labels with stale: older than the form's newest sense."""
    return labels.join(sent(stored(latest, "latest")), "form", "left").withColumn("stale", F.coalesce(F.col("updated_at") < F.col("latest"), F.lit(False))).drop("latest")


def mixture(rows: DataFrame, k: int, share: float, seed: str) -> DataFrame:
    """For each form k rows: share of them stale as far as there are, the rest fresh."""
    n = _sizes(rows, ["form", "stale"])
    return _mixed(rows, n.select("form").distinct().withColumn("n", F.lit(k)), n, share, seed)


def mixed(rows: DataFrame, wanted: DataFrame, share: float, seed: str) -> DataFrame:
    """For each form of wanted(form, n) n rows of rows(form, doc_id, byte_offset, stale, more): share of them stale as far as there are, the rest fresh."""
    return _mixed(rows, wanted, _sizes(rows, ["form", "stale"]), share, seed)


def _mixed(rows: DataFrame, wanted: DataFrame, n: DataFrame, share: float, seed: str) -> DataFrame:
    stale = n.groupBy("form").agg(F.sum(F.when(F.col("stale"), F.col("_n")).otherwise(0)).alias("n_stale"))
    quota = F.least(F.floor(F.col("n") * share), F.col("n_stale"))
    k = F.when(F.col("stale"), quota).otherwise(F.col("n") - quota)
    sizes = stored(n.join(wanted.join(stale, "form"), "form").select("form", "stale", "_n", k.cast("long").alias("_most")).where("_most > 0"), "quotas")
    few = _first(rows.join(sent(sizes).select("form", "stale", F.col("_most").alias("_k")), ["form", "stale"]), ["form", "stale"], F.col("_k"), seed, ["doc_id", "byte_offset"], sizes)
    return few.drop("rank", "_k")


def critic_groups(labels: DataFrame, senses: DataFrame, least: int = 5, most: int = 20, seed: str = "critic") -> DataFrame:
    """Labels to review: known sense, not reviewed since it changed, least to most of each sense."""
    s = sent(stored(senses.select(F.col("id").alias("sense_key"), F.col("updated_at").alias("changed")), "changes"))
    x = labels.join(s, "sense_key").where(F.col("last_critic").isNull() | (F.col("last_critic") < F.col("changed")))
    enough = _sizes(x, ["sense_key"], most).where(F.col("_n") >= least)
    return _first(x, ["sense_key"], most, seed, ["doc_id", "byte_offset"], enough)


def batch_sample(occurrences: DataFrame, labels: DataFrame, senses: DataFrame, budget: int, seed: str, share: float = 0.1, least: int = 5) -> DataFrame:
    """(form, doc_id, byte_offset, stale): the occurrences that a batch asks about, about budget in all.

    Of the case variants of a form the first one with senses stands for all: their occurrences are
    one pool. The budget goes to forms by the weight of their senses (sense_weights, with labels of
    rating 2), capped by the occurrences without a label of rating 1 or 2, for forms with at least
    `least` occurrences. Of a form's part, share is drawn from the labels that are older than its
    newest sense, as far as there are, and the rest from the occurrences without such a label.
    occurrences(form, doc_id, byte_offset); labels(form, doc_id, byte_offset, sense_key, rating, updated_at).
    """
    low = F.lower("form").alias("low")
    rep = senses.groupBy(low).agg(F.min("form").alias("form"))
    counts = labels.groupBy("form", "sense_key").agg(F.count_if(F.col("rating") == 2).alias("n"))
    totals = occurrences.groupBy(low).agg(F.count("*").alias("total")).where(F.col("total") >= least)
    good = labels.where("rating >= 1")
    done = good.groupBy("form").agg(F.count("*").alias("done"))
    pool = rep.join(totals, "low").join(sense_weights(senses, counts), "form").join(done, "form", "left")
    shares = stored(allocate(pool.select("form", "weight", (F.col("total") - F.coalesce("done", F.lit(0))).alias("avail")), budget), "shares")
    latest = senses.groupBy("form").agg(F.max("updated_at").alias("latest"))
    mine = good.join(shares.select("form"), "form", "left_semi")
    stale = stale_split(mine, latest).where("stale").select("form", "doc_id", "byte_offset", "stale")
    own = rep.join(shares.select("form"), "form", "left_semi")
    every = occurrences.select(low, "doc_id", "byte_offset").join(own, "low").select("form", "doc_id", "byte_offset")
    fresh = every.join(mine.select("form", "doc_id", "byte_offset"), ["form", "doc_id", "byte_offset"], "left_anti").withColumn("stale", F.lit(False))
    return mixed(stale.unionByName(fresh), shares, share, seed)


def chunks(rows: DataFrame, order: list[str], size: int = 50_000) -> DataFrame:
    """Rows with custom_id, counted from 0 in order, and their chunk."""
    return numbered(rows, order, "custom_id").withColumn("chunk", F.floor(F.col("custom_id") / size))


def pinned(pins: DataFrame, existing: DataFrame, group: list[str], key: list[str]) -> DataFrame:
    """Of each group's pins those that exist; all of them where none does."""
    both = pins.select(*group, *key).intersect(existing.select(*group, *key)).withColumn("there", F.lit(True))
    some = both.select(*group).distinct().withColumn("some", F.lit(True))
    x = pins.join(both, [*group, *key], "left").join(some, group, "left")
    return x.where("there or some is null").drop("there", "some")
