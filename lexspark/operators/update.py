"""The update cycle: induce senses, apply them, label occurrences; and parts of speech.

Models are functions from prompts to answers (see annotate). What one answered is stored before
it is used, so that a lost executor or a second action does not ask it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators import annotate, menus, state, work
from lexspark.operators.annotate import Model
from lexspark.operators.store import stored

#: Contexts shown for a form or sense, and occurrences labelled for a form, in one cycle.
MAX_CONTEXTS = 20
MAX_LABELS = 15
# fixed values: the parts of speech
POS = ("noun", "verb", "adjective", "adverb", "preposition", "conjunction", "pronoun", "determiner", "interjection", "proper_noun", "other")


def _shown(rows: DataFrame, group: list[str]) -> DataFrame:
    """Up to MAX_CONTEXTS contexts of each group, as an array; the sample is cut before the shuffle."""
    x = work.uniform_sample(rows, group, MAX_CONTEXTS, "shown", ["doc_id", "byte_offset"])
    return x.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "context"))), lambda c: c.context).alias("contexts"))


def _known(senses: DataFrame) -> DataFrame:
    """The definitions of each form in order."""
    return senses.groupBy("form").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "definition"))), lambda s: s.definition).alias("known"))


def _accepted() -> Column:
    """Whether the critic answered and did not object."""
    return F.col("answer").isNotNull() & F.coalesce("answer.ok", F.lit(True))


def induce(targets: DataFrame, occurrences: DataFrame, senses: DataFrame, model: Model) -> DataFrame:
    """(form, definition, seq): what the model adds to the senses of targets(form), as far as its critic agrees.

    occurrences are (form, doc_id, byte_offset, context), senses (form, position, definition). A
    target without occurrences, or without a readable answer, gets none; repeated targets count once.
    """
    shown = _shown(occurrences.join(targets.select("form").distinct(), "form", "left_semi"), ["form"])
    known = F.coalesce("known", F.array().cast("array<string>"))
    x = shown.join(_known(senses), "form", "left").select("form", annotate.sense_prompt(F.col("form"), F.col("contexts"), known).alias("prompt"))
    got = stored(annotate.ask(x, model, annotate.SCHEMAS["senses"]), "induced")
    new = got.select("form", F.posexplode("answer.senses").alias("seq", "s")).select("form", F.trim("s.definition").alias("definition"), "seq").where("definition <> ''")
    judged = new.withColumn("prompt", annotate.critic_prompt(F.col("form"), F.col("definition"), F.lit("Is this a sense of the word?")))
    return stored(annotate.ask(judged, model, annotate.SCHEMAS["critic"]), "judged").where(_accepted()).select("form", "definition", "seq")


def label(targets: DataFrame, occurrences: DataFrame, senses: DataFrame, labels: DataFrame, model: Model) -> DataFrame:
    """(form, doc_id, byte_offset, sense_key, rating, synonyms) for up to MAX_LABELS occurrences of each target.

    Occurrences count in any case. The menu has the senses of all case variants of the target and of
    their bases (see menus), and a label belongs to the entry that owns the sense chosen. What
    has a label of rating 1 or 2 is not asked about again, nor are targets whose menu is empty;
    answers outside the menu or the ratings are dropped. The keys 0 (noise) and _none (no sense
    covers it) stay with the target.
    """
    menu = menus.entries(senses)
    own = targets.select("form").distinct().where("form is not null").withColumn("low", F.lower("form")).join(menus.texts(menu), F.col("low") == F.col("menu"))
    owners = menu.select(F.col("menu").alias("low"), F.col("owner").alias("form")).union(own.select("low", "form")).distinct()
    done = labels.where("rating >= 1").join(owners, "form").select("low", *state.KEY[1:])
    seen = occurrences.select(F.lower("form").alias("low"), "doc_id", "byte_offset", "context").join(done, ["low", *state.KEY[1:]], "left_anti")
    todo = work.uniform_sample(seen.join(own, "low"), ["form"], MAX_LABELS, "label", ["doc_id", "byte_offset"])
    x = todo.select(*state.KEY, annotate.label_prompt(F.col("form"), F.col("text"), F.col("context")).alias("prompt"))
    got = stored(annotate.ask(x, model, annotate.SCHEMAS["menu"]), "labelled").select(*state.KEY, "answer.*")
    return menus.resolved(got, menu).select(*state.KEY, "sense_key", "rating", "synonyms")


def cycle(targets: DataFrame, occurrences: DataFrame, senses: DataFrame, labels: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """The senses and labels after one cycle over the targets; labelling sees the senses just induced."""
    after = stored(state.add_senses(senses, induce(targets, occurrences, senses, model)), "senses")
    new = label(targets, occurrences, after, labels, model)
    # one occurrence can be asked about for two variants of a form, and come out as one sense
    new = new.groupBy(*state.KEY).agg(F.max_by(F.struct("sense_key", "rating", "synonyms"), F.struct("rating", "sense_key")).alias("r")).select(*state.KEY, "r.*")
    return after, state.upsert(labels, new.select(*labels.columns), state.KEY)


def select_targets(occurrences: DataFrame, labels: DataFrame, n: int, seed: str, least: int = 5, alpha: float = 1.0) -> DataFrame:
    """n forms, drawn in proportion to the square root of the work that they are estimated to need.

    Only forms with an ASCII letter and at least `least` occurrences; covered are labels of rating 2.
    """
    totals = occurrences.where(F.col("form").rlike(X.ASCII_LETTER)).groupBy("form").agg(F.count("*").alias("total")).where(F.col("total") >= least)
    counts = labels.groupBy("form").agg(F.count("*").alias("n_labeled"), F.count_if(F.col("rating") == 2).alias("n_covered"))
    return work.weighted_sample(work.need(totals, counts, alpha).withColumn("w", F.sqrt("need_work")), "w", "form", n, seed).select("form")


def full_cycle(occurrences: DataFrame, senses: DataFrame, labels: DataFrame, model: Model, n: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """Selects n targets, induces their senses, and labels them: the senses and labels afterwards."""
    targets = stored(select_targets(occurrences, labels, n, seed), "targets")
    return cycle(targets, occurrences, senses, labels, model)


def tag_pos(senses: DataFrame, instances: DataFrame, model: Model) -> DataFrame:
    """(form, op, position, arg): update_pos events for senses(form, position, definition, pos) whose pos is null.

    instances(form, position, doc_id, byte_offset, context) are shown as far as there are any. A
    part of speech outside POS, or that the critic rejects, makes no event.
    """
    shown = _shown(instances, ["form", "position"])
    x = senses.where("pos is null").select("form", "position", "definition").join(shown, ["form", "position"], "left")
    x = x.withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
    asked = x.withColumn("prompt", annotate.pos_prompt(F.col("form"), F.col("definition"), F.col("contexts"), POS))
    tagged = stored(annotate.ask(asked, model, annotate.SCHEMAS["pos"]), "tagged").select("form", "position", "definition", F.col("answer.pos").alias("arg")).where(F.col("arg").isin(*POS))
    prompt = annotate.critic_prompt(F.col("form"), F.col("definition"), F.concat(F.lit("Is its part of speech "), F.col("arg"), F.lit("?")))
    judged = stored(annotate.ask(tagged.withColumn("prompt", prompt), model, annotate.SCHEMAS["critic"]), "judged")
    return judged.where(_accepted()).select("form", F.lit("update_pos").alias("op"), "position", "arg")
