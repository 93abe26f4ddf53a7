"""Menus over case variants and bases, answers mapped back, and the choice among JSON objects."""

import json

from pyspark.sql import functions as F

from lexspark.operators import annotate, menus, update

SENSES = "id string, form string, position int, definition string, pos string, morph_base string"
ROWS = [
    ("p1", "pots", 1, "plural of pot", None, "pot"), ("P1", "POTS", 1, "old phone lines", "noun", None), ("b1", "pot", 1, "a vessel", "noun", None), ("b2", "pot", 2, "a plant", None, "plant"),
    ("l1", "plant", 1, "grows", None, None), ("c1", "cyc", 1, "see lic", None, "lic"), ("i1", "lic", 1, "see cyc", None, "cyc"), ("m1", "mix", 1, "own", None, None), ("m2", "mix", 2, "derived", None, "pot"),
    ("t1", "two", 1, "x", None, "pot"), ("t2", "two", 2, "y", None, "mix"), ("n1", "lost", 1, "no base entry", None, "nowhere"),
]


def test_menus(spark):
    x = menus.entries(spark.createDataFrame(ROWS, SENSES))
    got = {r.menu: r.text for r in menus.texts(x).collect()}
    assert got == {
        "pots": "[POTS]\n1. [noun] old phone lines\n\n[pots]\n2. [noun] a vessel\n3. a plant",
        "pot": "1. [noun] a vessel\n2. a plant\n\nBase form 'plant':\n3. grows",
        "plant": "1. grows", "cyc": "1. see cyc", "lic": "1. see lic", "mix": "1. own\n2. derived\n\nBase form 'pot':\n3. [noun] a vessel\n4. a plant", "two": "1. x\n2. y",
    }
    assert {r.key: (r.id, r.owner) for r in x.where("menu = 'pots'").collect()} == {"1": ("P1", "POTS"), "2": ("b1", "pot"), "3": ("b2", "pot")}
    # an entry without senses is a variant too
    more = menus.texts(menus.entries(spark.createDataFrame(ROWS, SENSES), spark.createDataFrame([("Plant",)], "form string"))).where("menu = 'plant'").first()
    assert more.text == "[plant]\n1. grows"
    assert menus.texts(menus.entries(spark.createDataFrame([], SENSES))).count() == 0


def test_answers_belong_to_the_owner(spark):
    x = menus.entries(spark.createDataFrame(ROWS, SENSES))
    a = spark.createDataFrame([("Pots", 1, " 2 ", 2), ("Pots", 2, "0", 0), ("Pots", 3, "_none", 0), ("Pots", 4, "9", 1), ("Pots", 5, "1", 3), ("Pots", 6, None, 1), ("Pots", 7, "1", None)], "form string, doc_id long, sense string, rating int")
    got = {r.doc_id: (r.form, r.sense_key, r.rating) for r in menus.resolved(a, x).collect()}
    assert got == {1: ("pot", "b1", 2), 2: ("Pots", "0", 0), 3: ("Pots", "_none", 0)}


def test_labelling_sees_variants_and_bases(spark):
    asked = []

    def model(prompts):
        out = []
        for p in prompts:
            assert "_none" in p and "synonyms" in p
            out.append(json.dumps({"thinking": 1}) + " so " + json.dumps({"sense": 3, "rating": 2, "synonyms": ["herb"]}) + ' {"note": 0}')
        return out

    occ = spark.createDataFrame([("POTS", 1, 0, "a"), ("pots", 2, 0, "b"), ("pots", 3, 0, "c"), ("pot", 4, 0, "d")], "form string, doc_id long, byte_offset long, context string")
    labels = spark.createDataFrame([("pots", 3, 0, "b1", 2), ("pots", 2, 0, "0", 0)], "form string, doc_id long, byte_offset long, sense_key string, rating int")
    senses = spark.createDataFrame(ROWS, SENSES)
    got = update.label(spark.createDataFrame([("pots",), ("ghost",)], "form string"), occ, senses, labels, model).collect()
    assert sorted((r.form, r.doc_id, r.sense_key, r.rating, tuple(r.synonyms)) for r in got) == [("pot", 1, "b2", 2, ("herb",)), ("pot", 2, "b2", 2, ("herb",))] and not asked


def test_targets_and_full_cycle(spark):
    occ = spark.range(200).select(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("7")), (F.col("id") % 3 + 1).cast("int")).alias("form"), F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("byte_offset"), F.lit("x").alias("context"))
    occ = occ.unionByName(occ.limit(2).withColumn("form", F.lit("rare")))
    labels = spark.createDataFrame([], "form string, doc_id long, byte_offset long, sense_key string, rating int")
    assert sorted(r.form for r in update.select_targets(occ, labels, 9, "s").collect()) == ["a", "b"]
    model = lambda ps: ['{"senses": [{"definition": "d"}]}' if p.startswith("Define") else "{}" if p.startswith("Is ") else '{"sense": 1, "rating": 1}' for p in ps]
    senses, after = update.full_cycle(occ, spark.createDataFrame([], "form string, position int, definition string"), labels, model, 1, "s")
    assert senses.count() == 1 and after.count() == update.MAX_LABELS


def test_the_answer_among_objects():
    found = lambda a: annotate.found_json(a, ("sense", "rating"))
    assert found('{"draft": 1} then {"sense": "1"} and {"end": 2}') == '{"sense": "1"}'
    assert found('{"sense": "0"} no, {"sense": "2"}') == '{"sense": "2"}'
    assert found('{"a": 1} {"b": 2}') == '{"a": 1}'
    assert found('x ```json\n{"a": {"sense": 1}}\n``` {"sense": "2"}') == '{"a": {"sense": 1}}'
    assert found("none {here} [1]") is None
