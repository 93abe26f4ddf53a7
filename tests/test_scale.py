"""Steps that once shuffled whole texts or all tokens, against brute force, and by their plans."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators import index, mwe, work
from lexspark.plans import derived as T
from lexspark.plans.catalogue import QUERIES

rnd = random.Random(3)
WORDS = ["a", "Bé", "über", "x1", "—", "'s", "\n", "\t ", "  ", "w" * 90, "漢字", "𝒳", "end.", "-", " " * 70]
TEXTS = ["", None, " ", "w" * 500, "." * 200, "one", "a-b"] + ["".join(rnd.choice(WORDS) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 150))) for _ in range(25)]


def _brute(text):
    return [(m[1], m.start(1), m.end(1)) for m in re.finditer(r"[ \t\n\x0b\f\r]*([^\W_]+|[^ \t\n\x0b\f\r])", text or "")]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_next_tokens_without_a_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = []
    for i, x in enumerate(TEXTS):
        t = [f for f, *_ in _brute(x)] + [None, None]
        want += [(i, t[k], t[k + 1], t[k + 2]) for k in range(len(t) - 2)]
    key = lambda r: tuple(str(v) for v in r)
    for block, chunk in ((4000, 60), (50, 7), (9, 3)):
        monkeypatch.setattr(index, "BLOCK", block)
        monkeypatch.setattr(index, "CHUNK", chunk)
        a = mwe.adjacency(index.followed(index.segments(docs)))
        assert sorted([(r.doc_id, r.w1, r.w2, r.w3) for r in a.collect()], key=key) == sorted(want, key=key)
        assert "Exchange" not in _plan(a)


def test_contexts_without_a_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = sorted((i, f, len(x[:a].encode()), x[max(a - 30, 0) : a], x[b : b + 30]) for i, x in enumerate(TEXTS) for f, a, b in _brute(x))
    for block, chunk in ((4000, 60), (50, 7)):
        monkeypatch.setattr(index, "BLOCK", block)
        monkeypatch.setattr(index, "CHUNK", chunk)
        c = index.in_context(docs, 30)
        assert sorted(map(tuple, c.collect())) == want
        assert "Exchange" not in _plan(c)
        some = [w for i, w in enumerate(want) if i % 7 == 0]
        only = spark.createDataFrame([(f, i, at) for i, f, at, *_ in some], "form string, doc_id long, byte_offset long")
        assert sorted(map(tuple, index.in_context(docs, 30, only).collect())) == some


def _write(spark, tmp_path):
    rows = [(i, " ".join(["lexicon", "the", "of"][(i * k) % 3] for k in range(60)), f"s{i % 3}") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")


def test_labels_are_not_shuffled_for_the_vocabulary_or_the_documents(spark, tmp_path):
    _write(spark, tmp_path)
    x = T.reserved(spark, str(tmp_path), ("source", "year"))
    plan = _plan(x)
    assert "BroadcastHashJoin" in plan and "Exchange hash" not in plan
    assert {(r.doc_id, r.source, r.year) for r in x.collect()} == {(i, f"s{i % 3}", 1590 + i * 37 % 440 if i % 10 else None) for i in range(30)}


def test_first_rows_of_frequent_and_odd_groups(spark):
    rows = [("big", i, 0) for i in range(5000)] + [("twin", 7, 1)] * 300 + [(None, i, 2) for i in range(400)] + [("few", i, 3) for i in range(4)]
    df = spark.createDataFrame(rows, "g string, doc_id long, byte_offset long").repartition(4)
    got = work.uniform_sample(df, ["g"], 5, "s", ["doc_id", "byte_offset"])
    h = lambda r: hashlib.md5(f"s|{r[1]}|{r[2]}".encode()).hexdigest()
    for g in ("big", "twin", None, "few"):
        want = sorted((r for r in rows if r[0] == g), key=h)[:5]
        assert sorted(((r.g, r.doc_id, r.byte_offset) for r in got.collect() if r.g == g), key=h) == want, g


def test_rows_astray(spark):
    docs = spark.createDataFrame([(1, "naïve cat"), (2, None), (3, "cat")], "doc_id long, text string")
    rows = spark.createDataFrame([(1, 0, "naïve"), (1, 7, "cat"), (1, 6, "cat"), (2, 0, "x"), (3, 0, "dog"), (3, 0, "cat")], "doc_id long, byte_offset long, claim string")
    assert sorted(map(tuple, index.astray(rows, docs, "claim").collect())) == [(1, 6, "cat"), (3, 0, "dog")]


def test_small_shares_as_text(spark):
    want = {0.0: "0.0", 1.0: "1.0", 0.5: "0.5", 0.333333: "0.333333", 0.001: "0.001", 0.000512: "0.000512", 0.0001: "0.0001", 0.00009: "9e-05", 0.000012: "1.2e-05", 0.00001: "1e-05", 0.000001: "1e-06"}
    got = spark.createDataFrame([(x,) for x in want], "x double").select("x", X.number(F.col("x")).alias("t")).collect()
    assert {r.x: r.t for r in got} == want


def test_pairs_of_rare_words_are_not_counted(spark):
    rows = [(1, k, w) for k, w in enumerate(["hot", "dog", "x"] * 12 + ["rare", "pair"] * 3)]
    t = spark.createDataFrame(rows, "doc_id long, byte_offset long, form string")
    assert {r.form: r["count"] for r in mwe.pmi(t, min_pmi=-1e9).collect()} == {"hot dog": 12, "dog x": 12, "x hot": 11}


def test_kde_points_are_not_shuffled(spark, tmp_path):
    _write(spark, tmp_path)
    plan = QUERIES["year_kde"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.replace("BroadcastHashJoin", "") and plan.count("Exchange hash") == 2


def test_greedy_stores_only_grams_that_others_index(spark, monkeypatch):
    from lexspark.operators import dedup

    kept = {}
    own = dedup.stored
    monkeypatch.setattr(dedup, "stored", lambda df, name: kept.setdefault(name, own(df, name)) if name == "greedy-near" else own(df, name))
    monkeypatch.setattr(dedup, "drop_stored", lambda df: None)
    texts = [" ".join(f"d{i}w{k}" for k in range(200)) for i in range(5)] + [" ".join(f"d0w{k}" for k in range(60))]
    got = dedup.greedy(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.accepted for r in got.collect()} == {0: True, 1: True, 2: True, 3: True, 4: True, 5: False}
    assert {r.o for r in kept["greedy-near"].collect()} == {5} and kept["greedy-near"].count() == 6


def test_first_rows_of_a_keyed_table_are_read_without_a_shuffle(spark, tmp_path):
    from lexspark.operators.versions import Change, Store, Table

    s = Store(spark, str(tmp_path / "s"), {"t": Table("k string, n long", ("k",))})
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "k string, n long")
    s.update(lambda now: Change({"t": rows}, {"t": spark.createDataFrame([("z",)], "k string")}))
    assert sorted(map(tuple, s.table("t").collect())) == [("a", 1), ("b", 2)] and "Exchange" not in _plan(s.table("t"))
    s.update(lambda now: Change({"t": rows.where("k = 'b'").limit(1).withColumn("n", F.lit(5).cast("long"))}, {"t": spark.createDataFrame([("a",)], "k string")}))
    assert [tuple(r) for r in s.table("t").collect()] == [("b", 5)]


def test_first_batch_of_events_is_not_copied(spark, tmp_path, monkeypatch):
    from lexspark.streaming import events

    rows = [("1", "upsert", "f", 1, 0, "s", 1, 1), ("2", "upsert", "f", 1, 0, "r", 2, 1), ("2", "upsert", "f", 1, 0, "r", 2, 1), ("3", "delete_by_form", "g", None, None, None, 3, 1), ("4", "upsert", "g", 1, 9, "s", 2, 1), (None, "upsert", "h", 1, 3, "s", 2, 1)]
    spark.createDataFrame(rows, events.EVENT).write.parquet(f"{tmp_path}/e/f")
    names = []
    own = events.stored
    monkeypatch.setattr(events, "stored", lambda df, name: names.append(name) or own(df, name))
    s = events.follow(spark, f"{tmp_path}/e/*", f"{tmp_path}/store")
    assert [tuple(r) for r in s.table("labels").collect()] == [("f", 1, 0, "r")] and [tuple(r) for r in s.table("counts").collect()] == [("r", 1)]
    assert s.table("dead").count() == 1 and s.table("seen").count() == 4
    assert not {"batch", "touched"} & set(names)
