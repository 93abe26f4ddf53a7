"""The dictionary as versioned tables: entries, senses, labels and blocked forms change together.

Every function is one commit of a store (see versions). A change that reads and writes few forms
names them, so that writers of other forms are not in its way; with more than MOST_NAMED it counts
as touching any.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators import state
from lexspark.operators.store import sent, stored
from lexspark.operators.versions import Change, Snapshot, Store, Table, replaced

TABLES = {
    "entries": Table("form string, variant_of string, updated_at timestamp", ("form",)),
    "senses": Table("id string, form string, position int, definition string, pos string, morph_base string, morph_relation string, model string, updated_at timestamp", ("id",)),
    "labels": Table("form string, doc_id long, byte_offset long, sense_key string, rating int, updated_at timestamp", tuple(state.KEY), options=(("compression", "zstd"),)),
    "blocked": Table("form string, reason string", ("form",)),
}
CONTENT = ("definition", "pos", "morph_base", "morph_relation", "model")
MOST_NAMED = 1000
#: Decisions on entries: op is one of OPS; position (from 1) names a sense; arg is a reason, a form, a definition or a part of speech.
DECISIONS = "form string, op string, position int, arg string, base string, relation string, promote boolean"
OPS = ("delete_entry", "normalize_case", "spelling_variant", "blocklist", "add_senses", "morph_redirect", "rewrite", "update_pos", "prune")


def opened(spark: SparkSession, root: str) -> Store:
    return Store(spark, root, TABLES)


def named(*forms: DataFrame) -> list[str] | None:
    """The distinct forms of one-column tables, or None if there are more than MOST_NAMED."""
    every = forms[0]
    for f in forms[1:]:
        every = every.union(f)
    rows = every.distinct().limit(MOST_NAMED + 1).collect()
    return None if len(rows) > MOST_NAMED else [r[0] for r in rows if r[0] is not None]


def _of(rows: DataFrame, forms: DataFrame) -> DataFrame:
    return rows.join(forms.select(F.col(forms.columns[0]).alias("form")).distinct(), "form", "left_semi")


def _placed(senses: DataFrame, order: list[str | Column]) -> DataFrame:
    """senses with their positions counted anew, from 1, by form."""
    return senses.withColumn("position", F.row_number().over(Window.partitionBy("form").orderBy(*order)).cast("int"))


def _stamped(new: DataFrame, old: DataFrame, at: Column) -> DataFrame:
    """new senses; updated_at stays where old has the id with the same content, else it is at."""
    before = old.select(F.col("id").alias("_id"), F.struct(*CONTENT).alias("_old"), F.col("updated_at").alias("_at"))
    x = new.drop("updated_at").join(before, F.col("id") == F.col("_id"), "left")
    same = F.col("_id").isNotNull() & F.struct(*CONTENT).eqNullSafe(F.col("_old"))
    return x.withColumn("updated_at", F.when(same, F.col("_at")).otherwise(at)).select(*old.columns)


def write_entries(store: Store, entries: DataFrame, senses: DataFrame, at: str) -> int:
    """Puts whole entries(form, variant_of) with their senses (all columns but updated_at, in order of position).

    A sense of one of the forms that the new entry lacks is removed by its id; one that it has keeps
    its time unless its content changed; an id of another entry moves here. Entries of which no
    sense is given end up without any. Forms must not repeat, nor ids.
    """
    when = F.lit(at).cast("timestamp")

    def change(now: Snapshot) -> Change:
        every = now.table("senses")
        old = _of(every, entries.select("form"))
        moved = every.join(senses.select("id"), "id", "left_semi").join(entries.select("form"), "form", "left_anti")
        new = _stamped(_placed(_of(senses, entries.select("form")), ["position"]), old.unionByName(moved), when)
        put, drop = replaced(old, new, ["id"])
        return Change({"entries": entries.select("form", "variant_of", when.alias("updated_at")), "senses": put}, {"senses": drop})

    names = named(entries.select("form"), senses.select("id"))
    return store.update(change, names)


def update_entries(store: Store, forms: list[str], change: Callable[[DataFrame], DataFrame | None], at: str) -> int:
    """Reads the senses of some forms, and writes what change makes of them: all or nothing, as if alone.

    If another writer changes one of these forms meanwhile, change is called again on what that one
    wrote. A change to None leaves everything as it is. Senses must keep to the forms.
    """
    when = F.lit(at).cast("timestamp")
    own = store.spark.createDataFrame([(f,) for f in forms], "form string")

    def run(now: Snapshot) -> Change | None:
        old = _of(now.table("senses"), own)
        new = change(old)
        if new is None:
            return None
        put, drop = replaced(old, _stamped(_placed(_of(new, own), ["position"]), old, when), ["id"])
        there = now.table("entries").select("form")
        entries = put.select("form").distinct().join(there, "form", "left_anti").select("form", F.lit(None).cast("string").alias("variant_of"), when.alias("updated_at"))
        return Change({"senses": put, "entries": entries}, {"senses": drop})

    return store.update(run, forms)


def _allowed(senses: DataFrame, gone: DataFrame, by: str) -> DataFrame:
    """The forms of gone(id) of which no such sense has a model above by."""
    x = senses.join(gone.select("id"), "id", "left_semi")
    return x.groupBy("form").agg(F.bool_and(state.rank(F.lit(by)) >= state.rank(F.col("model"))).alias("ok")).where("ok").select("form")


def decide(now: Snapshot, decisions: DataFrame, by: str, at: str, anew: bool = False) -> Change:
    """The change that all decisions make at once; positions and existing forms are those of the snapshot.

    delete_entry blocks the form, and deletes its entry, senses and labels. normalize_case does the
    same without the block; if the form in arg has no entry, the senses move there (of several forms
    that move to one, the first sense of each definition, by form). Where a sense outranks by, an
    entry is not deleted. spelling_variant points the entry to arg. blocklist blocks a form, with or
    without an entry; add_senses adds the definitions of arg, a JSON array, that the form does not
    have in any case, and makes the entry where there is none.
    On single senses: morph_redirect sets base, relation and the definition in arg, and with promote
    adds the old definition to the base's senses; it is skipped if the base has no entry,
    or loses it.
    rewrite and update_pos set one value, unless the sense outranks by; prune removes senses with
    their labels, all that are named of a form or, if one outranks by, none. A position that the form
    lacks, and an unknown op, are skipped. Of a form that goes, decisions on senses are not looked at.
    With anew the labels that stay are written anew, which shuffles none of them; else the keys of
    those that go are dropped, and looked for at every reading.
    """
    when = F.lit(at).cast("timestamp")
    entries, every = now.table("entries"), now.table("senses")
    none = F.lit(None).cast("string")
    d = stored(decisions.where(F.col("op").isin(*OPS)), "decisions")

    # entries that go
    leave = d.where("op in ('delete_entry', 'normalize_case')").groupBy("form").agg(F.max_by(F.struct("op", "arg"), F.struct(F.col("op") == "delete_entry", "arg")).alias("d")).select("form", "d.*")
    leave = leave.join(entries.select("form"), "form", "left_semi")
    held = _of(every, leave)
    leave = stored(leave.join(held.where(state.rank(F.col("model")) > state.rank(F.lit(by))).select("form").distinct(), "form", "left_anti"), "leave")
    gone = leave.select("form")
    there = entries.join(gone, "form", "left_anti").select(F.col("form").alias("base"))
    to = leave.where("op = 'normalize_case'").select("form", F.col("arg").alias("to")).join(entries.select(F.col("form").alias("to")), "to", "left_anti")
    to = stored(to.where(F.col("to") != F.col("form")), "moves")
    moving = every.join(to, "form").withColumn("d", state.normal(F.col("definition")))
    first = Window.partitionBy("to", "d").orderBy("form", "position", "id")
    moving = moving.withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("from", F.struct("form", "position")).withColumn("form", F.col("to"))

    # senses that change
    own = d.join(gone, "form", "left_anti").where("position is not null").select("form", "position", "op", "arg", "base", "relation", "promote")
    at_sense = stored(own.join(every.select("form", "position", "id", F.col("definition").alias("was"), F.col("pos").alias("was_pos"), "model"), ["form", "position"]), "senses")
    redirect = at_sense.where("op = 'morph_redirect'").join(there, "base", "left_semi")
    trusted = state.rank(F.lit(by)) >= state.rank(F.col("model"))
    set_one = lambda op, name: F.max(F.when(F.col("op") == op, F.col("arg"))).alias(name)
    kept = at_sense.where(F.col("op").isin("rewrite", "update_pos") & trusted).unionByName(redirect)
    edits = kept.groupBy("id").agg(set_one("rewrite", "new_definition"), set_one("update_pos", "new_pos"), F.max(F.when(F.col("op") == "morph_redirect", F.struct("base", "relation", F.coalesce("arg", X.morph_definition(F.col("relation"), F.col("base"))).alias("definition")))).alias("r"))
    pruned = at_sense.where("op = 'prune'").select("id", "form").distinct()
    pruned = stored(_of(pruned, _allowed(every, pruned, by)), "pruned")
    promoted = redirect.where("promote").select(
        F.substring(F.sha2(F.concat_ws(">", "id", "base"), 256), 1, 32).alias("id"), F.col("base").alias("form"), F.struct("form", "position").alias("from"), F.col("was").alias("definition"), F.col("was_pos").alias("pos")
    ).dropDuplicates(["id"])

    given = d.where("op = 'add_senses'").join(gone, "form", "left_anti").select("form", F.posexplode(F.from_json("arg", "array<string>")).alias("n", "definition"))
    given = given.withColumn("d", state.normal(F.col("definition"))).where("d <> ''").groupBy("form", "d").agg(F.min("n").alias("n"), F.trim(F.min_by("definition", "n")).alias("definition"))
    has = every.select("form", state.normal(F.col("definition")).alias("d"))
    added = stored(given.join(has, ["form", "d"], "left_anti"), "added")

    touched = gone.union(to.select("to")).union(at_sense.select("form")).union(promoted.select("form")).union(added.select("form"))
    old = stored(_of(every, touched), "before")
    left = old.join(gone, "form", "left_anti").join(pruned.select("id"), "id", "left_anti").join(edits, "id", "left")
    edited = F.coalesce("new_definition", "new_pos").isNotNull() | F.col("r").isNotNull()
    start = F.struct(F.lit("").alias("form"), F.col("position").alias("position"))
    left = left.select(
        "id", "form", F.lit(0).alias("tier"), start.alias("from"), F.coalesce("new_definition", "r.definition", "definition").alias("definition"), F.coalesce("new_pos", "pos").alias("pos"),
        F.coalesce("r.base", "morph_base").alias("morph_base"), F.coalesce("r.relation", "morph_relation").alias("morph_relation"), F.when(edited, F.lit(by)).otherwise(F.col("model")).alias("model"),
    )
    more = promoted.select("id", "form", F.lit(1).alias("tier"), "from", "definition", "pos", none.alias("morph_base"), none.alias("morph_relation"), none.alias("model"))
    moved = moving.select("id", "form", F.lit(0).alias("tier"), "from", *CONTENT)
    fresh = added.select(F.substring(F.sha2(F.concat_ws("|", "form", "d"), 256), 1, 32).alias("id"), "form", F.lit(2).alias("tier"), F.struct("form", F.col("n").alias("position")).alias("from"), "definition", *[none.alias(c) for c in CONTENT[1:]])
    new = _placed(left.unionByName(more).unionByName(moved).unionByName(fresh), ["tier", "from", "id"]).drop("tier", "from")
    put, drop = replaced(old, _stamped(new, old, when), ["id"])

    # what else goes with them
    labels = now.table("labels")
    cut = pruned.select("form", F.col("id").alias("sense_key"))
    kept_labels = labels.join(sent(gone), "form", "left_anti").join(sent(cut), ["form", "sense_key"], "left_anti").select(*labels.columns)
    lost = labels.join(gone, "form", "left_semi").unionByName(labels.join(cut, ["form", "sense_key"], "left_semi").select(*labels.columns))
    variant = d.where("op = 'spelling_variant'").join(gone, "form", "left_anti").groupBy("form").agg(F.max("arg").alias("variant_of")).join(entries.select("form"), "form", "left_semi").select("form", "variant_of", when.alias("updated_at"))
    begun = to.select(F.col("to").alias("form")).union(added.select("form")).distinct().join(entries.select("form"), "form", "left_anti")
    made = begun.select("form", none.alias("variant_of"), when.alias("updated_at"))
    stops = leave.where("op = 'delete_entry'").select("form", "arg").unionByName(d.where("op = 'blocklist'").select("form", "arg"))
    blocked = stops.groupBy("form").agg(F.coalesce(F.max("arg"), F.lit("deleted")).alias("reason")).join(now.table("blocked").select("form"), "form", "left_anti")
    return Change({"senses": put, "entries": variant.unionByName(made), "blocked": blocked}, {"senses": drop, "entries": gone} | ({} if anew else {"labels": lost}), whole={"labels": kept_labels} if anew else {})


def from_events(events: DataFrame) -> DataFrame:
    """The decisions (DECISIONS) that review.events() stand for; what those reject, skip or send to a queue is left out."""
    op = F.when(F.col("op") == "normalise", "normalize_case").otherwise(F.col("op"))
    redirect = F.col("op") == "morph_redirect"
    x = events.where(op.isin(*OPS))
    return x.select("form", op.alias("op"), "position", F.when(~redirect, F.col("arg")).alias("arg"), F.when(redirect, F.col("arg")).alias("base"), F.lit(None).cast("string").alias("relation"), redirect.alias("promote"))


def apply_decisions(store: Store, decisions: DataFrame, by: str, at: str) -> int:
    """All decisions as one version of the store; see decide()."""
    forms = decisions.select("form").union(decisions.where("op in ('normalize_case', 'spelling_variant')").select("arg")).union(decisions.select("base"))
    names = named(forms)
    return store.update(lambda now: decide(now, decisions, by, at, names is None), names)


def upsert_labels(store: Store, labels: DataFrame, distinct: bool = False) -> int:
    """Puts labels in place of those of the same occurrence; distinct says that no occurrence comes twice, which need not be looked for then."""
    return store.update(lambda now: Change({"labels": labels}, distinct=frozenset({"labels"} if distinct else ())), named(labels.select("form")))
