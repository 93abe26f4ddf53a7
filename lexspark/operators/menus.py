"""The senses that a labeller chooses from: those of all case variants of a form, and of their base forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: keys that name no sense. Noise is never looked at again; what no sense covers asks for a new one
NOISE, UNCOVERED = "0", "_none"


def _with_defaults(senses: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    has = lambda c, other: F.col(c) if c in senses.columns else other
    key = F.concat_ws("#", "form", F.col("position").cast("string"))
    return senses.select(has("id", key).alias("id"), "form", "position", "definition", has("pos", none).alias("pos"), has("morph_base", none).alias("morph_base"))


def entries(senses: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    """(menu, key, id, owner, line): a row for each sense of each menu, numbered from 1 as key.

    senses are (form, position, definition) and, if there are, id, pos and morph_base; forms(form)
    are entries that may have no senses. menu is the lower-cased form: its variants come by form,
    with a heading each if there are several. A variant whose senses name exactly one base shows
    the senses of the base after its own, or, if all of its senses are derived, instead of them. A
    base is looked up once, so chains and cycles of bases end there. Senses with no id have that
    of form#position.
    """
    s = _with_defaults(senses)
    known = s.select("form").distinct()
    variants = (known if forms is None else known.union(forms.select("form")).distinct()).groupBy(F.lower("form").alias("menu")).agg(F.count("*").alias("variants"))
    base = F.when(F.min("morph_base") == F.max("morph_base"), F.min("morph_base"))
    own = s.groupBy("form").agg(base.alias("base"), F.bool_and(F.col("morph_base").isNotNull()).alias("derived"))
    sense = s.select(F.col("form").alias("owner"), "position", "id", "definition", "pos")
    first = own.where(~(F.col("derived") & F.col("base").isNotNull())).select("form", F.lit(0).alias("block"), F.lit(None).cast("string").alias("of"), F.col("form").alias("owner"))
    second = own.where("base is not null").select("form", F.lit(1).alias("block"), F.when(~F.col("derived"), F.col("base")).alias("of"), F.col("base").alias("owner"))
    x = first.unionByName(second).join(sense, "owner").withColumn("menu", F.lower("form")).join(variants, "menu")

    by_place = Window.partitionBy("menu").orderBy("form", "block", "position")
    begins = F.row_number().over(Window.partitionBy("menu", "form", "block").orderBy("position")) == 1
    x = x.withColumn("key", F.row_number().over(by_place)).withColumn("begins", begins)
    heading = F.when(F.col("of").isNotNull(), F.concat(F.lit("\nBase form '"), F.col("of"), F.lit("':\n"))).when(F.col("variants") > 1, F.concat(F.lit("\n["), F.col("form"), F.lit("]\n"))).otherwise("")
    tag = F.coalesce(F.concat(F.lit(" ["), F.col("pos"), F.lit("]")), F.lit(""))
    line = F.concat(F.when(F.col("begins"), heading).otherwise(""), F.col("key").cast("string"), F.lit("."), tag, F.lit(" "), F.col("definition"))
    return x.select("menu", F.col("key").cast("string").alias("key"), "id", "owner", line.alias("line"))


def texts(rows: DataFrame) -> DataFrame:
    """(menu, text, n) of entries(): the lines of each menu in order."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(F.col("key").cast("int").alias("key"), "line"))), lambda r: r.line)
    return rows.groupBy("menu").agg(F.regexp_replace(F.array_join(lines, "\n"), r"^\n+", "").alias("text"), F.count("*").alias("n"))


def resolved(answers: DataFrame, rows: DataFrame) -> DataFrame:
    """answers(form, sense, rating, more) as labels: sense_key and the form of the entry that owns the sense.

    sense is a key of the form's menu; a reserved key stands for itself, and belongs to the form asked
    about. Any other answer, and a rating outside 0 to 2, is dropped.
    """
    menu = rows.select(F.col("menu").alias("_menu"), F.col("key").alias("_key"), "id", "owner")
    x = answers.withColumn("_sense", F.trim("sense")).join(menu, (F.lower("form") == F.col("_menu")) & (F.col("_sense") == F.col("_key")), "left")
    reserved = F.col("_sense").isin(NOISE, UNCOVERED)
    x = x.where(F.col("rating").between(0, 2) & (F.col("id").isNotNull() | reserved))
    return x.withColumns({"sense_key": F.coalesce("id", "_sense"), "form": F.coalesce("owner", "form")}).drop("_menu", "_key", "_sense", "id", "owner", "sense")

