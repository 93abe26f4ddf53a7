"""Tokens, index, contexts, expressions, dedup, allocation and state on small tables."""

import random

from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators import dedup, index, mwe, state, stats, work

TEXTS = [(1, "The cat's  well-known hat, naïve £5 ☃ end.\n\nNew"), (2, "the hat"), (3, ""), (4, None)]


def _docs(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_offsets_and_contexts(spark):
    raw = {i: (t or "").encode() for i, t in TEXTS}
    got = index.tokenize(_docs(spark)).collect()
    assert got and all(raw[r.doc_id][r.byte_offset :].startswith(r.form.encode()) for r in got)
    x = spark.createDataFrame([(t, k) for _, t in TEXTS if t for k in range(len(t.encode()))], "t string, k int")
    for r in x.withColumn("c", X.char_offset(F.col("t"), F.col("k"))).collect():
        assert r.c == len(r.t.encode()[: r.k].decode(errors="ignore"))


def test_index(spark, tmp_path):
    t = index.tokenize(_docs(spark))
    path = str(tmp_path / "index")
    index.write_index(t.where("doc_id = 1"), path)
    index.write_index(t.where("doc_id = 2"), path)
    i = index.read_index(spark, path)
    assert i.count() == t.count()
    assert {(r.form, r.doc_id) for r in index.occurrences(i, "THE").collect()} == {("The", 1), ("the", 2)}
    assert {r.doc_id for r in index.unsegmented(_docs(spark), i).collect()} == {3, 4}


def test_expressions(spark):
    rows = [(i, "alpha beta x alpha-beta y") for i in range(4)] + [(9, "alpha"), (10, "beta")]
    t = index.tokenize(_docs(spark, rows))
    got = {r.form: r["count"] for r in mwe.pmi(t, min_count=2, min_pmi=0.0).collect()}
    assert got["alpha beta"] == 4 and got["alpha-beta"] == 4
    want = spark.createDataFrame([("alpha beta", ["Alpha", "beta"]), ("a-b", ["alpha", "-", "beta"])], "form string, components array<string>")
    found = mwe.find(t, want, lower=True)
    assert found.count() == 8 and mwe.find(t, want).count() == 4  # none across documents
    assert mwe.new_rows(found, found).count() == 0
    s = spark.createDataFrame([(["a", "'s", "b", "-", "c"],)], "c array<string>").select(X.surface(F.col("c"))).first()[0]
    assert s == "a's b-c"


def test_greedy_dedup(spark):
    rnd = random.Random(2)
    word = lambda: f"w{rnd.randrange(5000)}"
    base = [[word() for _ in range(200)] for _ in range(4)]
    docs = []
    for i in range(40):
        b = base[i % 4]
        k = rnd.randrange(0, 150)
        docs.append((i, " ".join(b[k : k + 50] + [word() for _ in range(rnd.randrange(0, 200))])))
    seen, want = set(), {}
    for i, t in docs:
        w = t.split()
        g = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        want[i] = not g or sum(x in seen for x in g) / len(g) < 0.05
        if want[i]:
            seen.update(g[::10])
    assert {r.doc_id: r.accepted for r in dedup.greedy(_docs(spark, docs)).collect()} == want


def test_allocation(spark):
    rows = [("a", 10.0, 5), ("b", 10.0, 100), ("c", 20.0, 100), ("d", 0.0, 9)]
    got = {r.form: r.n for r in work.allocate(spark.createDataFrame(rows, "form string, weight double, avail long"), 65).collect()}
    assert got == {"a": 5, "b": 20, "c": 40}
    assert {r.form: r.n for r in work.allocate(spark.createDataFrame(rows, "form string, weight double, avail long"), 10_000).collect()} == {"a": 5, "b": 100, "c": 100}


def test_sense_weights(spark):
    senses = [("cat#1", "cat", None), ("Cat#1", "Cat", None), ("cats#1", "cats", "cat"), ("cats#2", "cats", None), ("x#1", "x", "cat"), ("x#2", "x", "cats"), ("y#1", "y", "none")]
    n = spark.createDataFrame([("cat", "cat#1", 3), ("x", "cat#1", 99)], "form string, sense_key string, n long")
    got = {r.form: r.weight for r in work.sense_weights(spark.createDataFrame(senses, "id string, form string, morph_base string"), n).collect()}
    assert got == {"cat": 1.5, "Cat": 1.5, "cats": 2.5, "x": 2.0, "y": 1.0}  # two bases, and a base without senses, add nothing


def test_state(spark):
    senses = spark.createDataFrame([("x#1", "x", 1, "Old", "strong"), ("x#2", "x", 2, "two", "weak")], "id string, form string, position int, definition string, model string")
    change = spark.createDataFrame([("x#1", "new", "weak"), ("x#2", "new", "weak")], "id string, definition string, by string")
    assert {r.id: r.definition for r in state.rewrite(senses, change).collect()} == {"x#1": "Old", "x#2": "new"}
    assert state.prune(senses, change.select("id", "by")).count() == 2  # one sense outranks: all stay
    add = spark.createDataFrame([("x", " OLD ", 1), ("x", "three", 2), ("y", "why", 1)], "form string, definition string, seq int")
    got = {(r.form, r.position): r.definition for r in state.add_senses(senses, add).collect()}
    assert got == {("x", 1): "Old", ("x", 2): "two", ("x", 3): "three", ("y", 1): "why"}


def test_statistics(spark):
    c = spark.createDataFrame([("f", "a", "1", 10), ("f", "b", "2", 10)], "form string, source string, sense_key string, n long")
    d = stats.jsd(c).first().jsd
    assert 0.9 < d <= 1
    p = spark.createDataFrame([(float(i), float(i * i)) for i in range(10)], "x double, y double")
    assert abs(stats.spearman(p, "x", "y").first().rho - 1) < 1e-12
    assert abs(stats.t_pvalue(0.25, 10) - 0.14111328125) < 1e-9


def test_entry_without_llm(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        assert not [q for q in importlib.reload(e).queries() if q.startswith("op")]
        assert len(e.oracle_sql()) > 90
    finally:
        monkeypatch.undo()
        importlib.reload(e)
