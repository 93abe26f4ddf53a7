"""State as snapshots: base table and change set make the next table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.operators.store import sent, stored

KEY = ["form", "doc_id", "byte_offset"]
#: Bytes of a text, as a power of two, whose rows are dealt out together.
AREA_BITS = 16
#: Trust of the models, lowest first; an unknown or missing one is below all.
TRUST = ("weak", "strong")


def near(rows: DataFrame) -> DataFrame:
    """rows(KEY, more) with _area, dealt out by document and area of its text; windows by both and more take them as they are.

    Rows that were written side by side stay so, which their shuffle is compressed by; a long text
    is many areas.
    """
    area = F.shiftright("byte_offset", AREA_BITS)
    return rows.repartition("doc_id", area).withColumn("_area", area)


def upsert(base: DataFrame, change: DataFrame, key: list[str]) -> DataFrame:
    """base with the rows of change in place of those with the same key; a key with a null is like no other."""
    return unchanged(base, change, key).unionByName(change)


def unchanged(base: DataFrame, change: DataFrame, key: list[str]) -> DataFrame:
    """The rows of base whose key change does not have; a key with a null is like no other.

    Where the key has a place in a text, base and the keys of change are dealt out by it, once.
    """
    if set(KEY) - set(key):
        return base.join(change.select(*key), key, "left_anti")
    both = near(base.withColumn("_new", F.lit(False)).unionByName(change.select(*key, F.lit(True).alias("_new")), allowMissingColumns=True))
    first = ["doc_id", "_area", "byte_offset"]
    gone = F.max("_new").over(Window.partitionBy(*first, *[c for c in key if c not in first]))
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    return both.withColumn("_gone", gone & whole).where("not _new and not _gone").select(*base.columns)


def delete(base: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return base.join(keys.select(*on).distinct(), on, "left_anti")


def downgrade(labels: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Stamps reviewed(key, bad, at) labels; the bad ones fall to rating 0."""
    x = labels.join(reviewed, KEY, "left")
    return x.select(*KEY, "sense_key", F.when(F.coalesce("bad", F.lit(False)), 0).otherwise(F.col("rating")).cast("int").alias("rating"), F.coalesce("at", "last_critic").alias("last_critic"))


def rank(model: Column) -> Column:
    """Place in the trust order; 0 for unknown."""
    return F.coalesce(F.array_position(F.lit(list(TRUST)), model), F.lit(0))


def normal(definition: Column) -> Column:
    return F.lower(F.trim(definition))


def add_senses(senses: DataFrame, change: DataFrame) -> DataFrame:
    """Appends change(form, definition, seq) where the form has no such definition yet."""
    known = senses.select("form", normal(F.col("definition")).alias("d")).distinct()
    new = change.withColumn("d", normal(F.col("definition"))).join(known, ["form", "d"], "left_anti")
    last = senses.groupBy("form").agg(F.max("position").alias("last"))
    w = Window.partitionBy("form").orderBy("seq")
    new = new.join(last, "form", "left").withColumn("position", (F.coalesce("last", F.lit(0)) + F.row_number().over(w)).cast("int"))
    return senses.select("form", "position", "definition").unionByName(new.select("form", "position", "definition"))


def rewrite(senses: DataFrame, change: DataFrame) -> DataFrame:
    """Replaces definitions by change(id, definition, by) where by ranks no lower than the last writer."""
    x = senses.join(change.select("id", F.col("definition").alias("new"), "by"), "id", "left")
    ok = F.col("new").isNotNull() & (rank(F.col("by")) >= rank(F.col("model")))
    return x.select("id", "form", "position", F.when(ok, F.col("new")).otherwise(F.col("definition")).alias("definition"), F.when(ok, F.col("by")).otherwise(F.col("model")).alias("model"))


def prune(senses: DataFrame, change: DataFrame) -> DataFrame:
    """Removes change(id, by), unless by is outranked on any of a form's removed senses."""
    hit = senses.join(change, "id").groupBy("form").agg(F.bool_and(rank(F.col("by")) >= rank(F.col("model"))).alias("ok")).where("ok").select("form")
    gone = senses.join(change.select("id"), "id", "left_semi").join(hit, "form", "left_semi").select("id")
    left = senses.join(gone, "id", "left_anti")
    return left.withColumn("position", F.row_number().over(Window.partitionBy("form").orderBy("position")).cast("int"))


def delete_entries(senses: DataFrame, change: DataFrame) -> DataFrame:
    """Removes the entries of change(form, by), unless any of their senses outranks by."""
    ok = senses.join(change, "form").groupBy("form").agg(F.bool_and(rank(F.col("by")) >= rank(F.col("model"))).alias("ok")).where("ok")
    return senses.join(ok.select("form"), "form", "left_anti")


def morph_redirect(senses: DataFrame, change: DataFrame) -> DataFrame:
    """Marks the senses of change(id, base, definition) as derived and copies promoted ones to the base."""
    x = senses.join(change.select("id", F.col("base").alias("nb"), F.col("definition").alias("nd")), "id", "left")
    own = x.select("form", "position", F.coalesce("nd", "definition").alias("definition"), F.coalesce("nb", "morph_base").alias("morph_base"))
    copy = change.where("promote").select("id", F.col("base").alias("nb"))
    moved = senses.select("id", F.struct("form", "position").alias("o"), "definition").join(copy, "id").select(F.col("nb").alias("form"), "definition", "o")
    last = senses.groupBy("form").agg(F.max("position").alias("last"))
    moved = moved.join(last, "form", "left").withColumn("position", (F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy("form").orderBy("o"))).cast("int"))
    return own.unionByName(moved.select("form", "position", "definition", F.lit(None).cast("string").alias("morph_base")))


def replay(events: DataFrame) -> DataFrame:
    """The live rows of a log of (form, doc_id, byte_offset, kind, sense_key, at, seq).

    Kinds: upsert, delete_by_sense, delete_by_form; the last upsert of a key (of several at once,
    that of the greatest sense key) stands unless a later delete names its form or sense. The
    deletes, one row a form or sense, are sent to the upserts; those of forms first, as the form is
    part of the key. What is left is dealt out by place and sorted there, once.
    """
    order = F.struct("at", "seq")
    by_sense = stored(events.where("kind = 'delete_by_sense'").groupBy("sense_key").agg(F.max(order).alias("ds")), "deletes")
    by_form = stored(events.where("kind = 'delete_by_form'").groupBy("form").agg(F.max(order).alias("df")), "deletes")
    up = events.where("kind = 'upsert'").join(sent(by_form), "form", "left").where(F.col("df").isNull() | (order > F.col("df")))
    w = Window.partitionBy("doc_id", "_area", "byte_offset", "form").orderBy(F.desc("at"), F.desc("seq"), F.desc("sense_key"))
    last = near(up.select(*KEY, "sense_key", "at", "seq")).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return last.join(sent(by_sense), "sense_key", "left").where(F.col("ds").isNull() | (order > F.col("ds"))).select(*KEY, "sense_key")


def queue_add(queue: DataFrame, forms: DataFrame) -> DataFrame:
    """queue(form, seq) with the forms(form, seq) that it lacks at its end."""
    new = forms.groupBy("form").agg(F.min("seq").alias("seq")).join(queue, "form", "left_anti")
    last = queue.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    return queue.unionByName(new.join(F.broadcast(last), F.lit(True)).select("form", (F.col("last") + 1 + F.col("seq")).alias("seq")))  # one row
