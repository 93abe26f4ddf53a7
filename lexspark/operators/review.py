"""Change events from reviewers' decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Operations on a whole entry; one of these stands alone in a review.
ENTRY = ("delete_entry", "spelling_variant", "blocklist", "skip", "enqueue", "add_senses")
#: Operations on one sense; these may be combined.
SENSE = ("rewrite", "prune", "morph_redirect", "update_pos", "normalise")
OPS = "array<struct<op:string, position:int, arg:string>>"


def events(reviews: DataFrame, senses: DataFrame) -> DataFrame:
    """(form, op, position, arg) of reviews(form, ops), ops as in OPS.

    A review whose operation on the entry does not stand alone, or with an unknown operation, is
    one event `rejected`. An operation on a sense that the form does not have is `skipped`.
    Deleting an entry blocks its form as well. An empty review makes no event.
    """
    n = senses.groupBy("form").agg(F.max("position").alias("n"))
    x = reviews.join(n, "form", "left")
    whole = F.size(F.filter("ops", lambda o: o.op.isin(*ENTRY)))
    odd = F.exists("ops", lambda o: ~F.coalesce(o.op.isin(*ENTRY, *SENSE), F.lit(False)))
    none = F.lit(None).cast("string")
    rejected = F.array(F.struct(F.lit("rejected").alias("op"), F.lit(None).cast("int").alias("position"), none.alias("arg")))
    blocked = F.transform(F.filter("ops", lambda o: o.op == "delete_entry"), lambda o: F.struct(F.lit("blocklist").alias("op"), F.lit(None).cast("int").alias("position"), o.arg.alias("arg")))
    there = lambda o: o.op.isin(*ENTRY) | F.coalesce(o.position.between(1, F.col("n")), F.lit(False))
    checked = F.transform("ops", lambda o: F.struct(F.when(there(o), o.op).otherwise("skipped").alias("op"), o.position.alias("position"), o.arg.alias("arg")))
    out = F.when(odd | ((whole > 0) & (F.size("ops") > 1)), rejected).otherwise(F.concat(checked, blocked))
    return x.select("form", F.explode(out).alias("e")).select("form", "e.op", "e.position", "e.arg")


def induction(decisions: DataFrame) -> DataFrame:
    """(form, ops) of decisions(form, blocked, base, definitions): a block, a redirect to the base, or new senses."""
    one = lambda op, arg: F.array(F.struct(F.lit(op).alias("op"), F.when(F.lit(op in SENSE), 1).alias("position"), arg.alias("arg")))
    ops = F.when(F.col("blocked"), one("blocklist", F.lit(None).cast("string"))).when(F.col("base").isNotNull(), one("morph_redirect", F.col("base"))).otherwise(one("add_senses", F.to_json("definitions")))
    return decisions.select("form", ops.alias("ops"))


def phrases(decisions: DataFrame) -> DataFrame:
    """(form, ops) of decisions(form, verdict, definitions): blocklist, skip, or approve with senses now or induction later."""
    one = lambda op, arg: F.array(F.struct(F.lit(op).alias("op"), F.lit(None).cast("int").alias("position"), arg.alias("arg")))
    none = F.lit(None).cast("string")
    ops = F.when(F.col("verdict") == "approve", F.when(F.size("definitions") > 0, one("add_senses", F.to_json("definitions"))).otherwise(one("enqueue", none)))
    return decisions.select("form", ops.when(F.col("verdict") == "skip", one("skip", none)).otherwise(one("blocklist", none)).alias("ops"))
