"""Batches, reviews, queues, prompts, sinks and the run of ingestion."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators import annotate, batch, jobs, review, store
from lexspark.sources import sinks


def test_batch_files(spark, tmp_path):
    todo = spark.createDataFrame([(f, i, 5) for f in ("a", "b", "none") for i in range(4)], "form string, doc_id long, byte_offset long")
    senses = spark.createDataFrame([("a", 2, 'two "2"'), ("a", 1, "one"), ("b", 1, "uno")], "form string, position int, definition string")
    x = batch.requests(todo, senses, 3)
    batch.write(x, str(tmp_path / "b"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "b/requests")).collect()]
    assert len(lines) == 8 and {tuple(r["senses"]) for r in lines} == {("one", 'two "2"'), ("uno",)}
    meta = spark.read.json(str(tmp_path / "b/metadata"))
    assert meta.groupBy("chunk").count().orderBy("chunk").select("count").toPandas()["count"].tolist() == [3, 3, 2]
    bodies = ['{"sense":1,"rating":2}', '{"sense":0,"rating":0}', "{oops", '{"sense":9,"rating":1}', '{"sense":1,"rating":7}', '{"rating":1}']
    replies = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)] + [(99, bodies[0])], "custom_id long, body string")
    done = batch.outcomes(replies, meta, senses)
    assert {r.custom_id: r.outcome for r in done.collect()} == {0: "ok", 1: "ok", 2: "malformed", 3: "unknown sense", 4: "malformed", 5: "malformed", 99: "unknown id"}
    assert sorted((r.sense_key, r.rating) for r in batch.labels(done).collect()) == [("0", 0), ("a#1", 2)]
    files = spark.createDataFrame([("f1", 4), ("f1", 3), ("f2", 0)], "file string, custom_id long")
    assert {r.file: r.chunk for r in batch.discover(files, meta).collect()} == {"f1": 1, "f2": 0}
    with pytest.raises(PySparkException):
        batch.discover(files.withColumn("custom_id", F.lit(50)), meta).collect()
    batch.archive(todo, [str(tmp_path / "b/requests")], str(tmp_path / "old"))
    assert not (tmp_path / "b/requests").exists() and (tmp_path / "old/requests").is_dir()


def test_reviews(spark):
    senses = spark.createDataFrame([("a", 1), ("a", 2)], "form string, position int")
    rows = [("a", [("rewrite", 2, "x"), ("prune", 3, None)]), ("a", [("delete_entry", None, "w")]), ("a", [("delete_entry", None, "w"), ("prune", 1, None)]), ("b", [("prune", 1, None)]), ("a", [("guess", 1, None)]), ("a", [])]
    got = [tuple(r) for r in review.events(spark.createDataFrame(rows, f"form string, ops {review.OPS}"), senses).collect()]
    assert sorted(got, key=str) == sorted([("a", "rewrite", 2, "x"), ("a", "skipped", 3, None), ("a", "delete_entry", None, "w"), ("a", "blocklist", None, "w"), ("a", "rejected", None, None), ("b", "skipped", 1, None), ("a", "rejected", None, None)], key=str)
    d = spark.createDataFrame([("a", True, None, []), ("b", False, "c", []), ("d", False, None, ["one"])], "form string, blocked boolean, base string, definitions array<string>")
    assert {r.form: (r.ops[0].op, r.ops[0].arg) for r in review.induction(d).collect()} == {"a": ("blocklist", None), "b": ("morph_redirect", "c"), "d": ("add_senses", '["one"]')}
    d = spark.createDataFrame([("a", "approve", ["x"]), ("b", "approve", []), ("c", "skip", []), ("d", "blocklist", [])], "form string, verdict string, definitions array<string>")
    assert [r.ops[0].op for r in review.phrases(d).orderBy("form").collect()] == ["add_senses", "enqueue", "skip", "blocklist"]


def test_queue(spark):
    q = jobs.enqueue(spark.createDataFrame([], "id long, state string, error string"), spark.range(5))
    q = jobs.claim(jobs.enqueue(q, spark.range(3, 7)), 3)
    q = jobs.settle(q, spark.createDataFrame([(0, None), (1, "broke"), (6, None)], "id long, error string"))
    want = {0: ("done", None), 1: ("failed", "broke"), 2: ("claimed", None)} | {i: ("pending", None) for i in (3, 4, 5, 6)}
    assert {r.id: (r.state, r.error) for r in q.collect()} == want
    assert {r.id for r in jobs.recover(q).where("state = 'pending'").collect()} == {2, 3, 4, 5, 6}


def test_answers_of_a_model(spark):
    said = {}

    def model(prompts):
        out = []
        for p in prompts:
            n = said[p] = said.get(p, 0) + 1
            out.append({"plain": '{"sense": 1, "rating": 2}', "fence": 'Well:\n```json\n{"sense": 2, "rating": 0}\n```', "scan": 'It is {x} {"sense": 3, "rating": 1} so', "late": "no" if n < 3 else '{"sense": 4}'}.get(p, "never"))
        return out

    rows = spark.createDataFrame([(p,) for p in ("plain", "fence", "scan", "late", "bad", None)], "prompt string").coalesce(1)
    got = {r.prompt: r.answer for r in annotate.ask(rows, model, annotate.SCHEMAS["label"]).collect()}
    assert [got[k] and tuple(got[k]) for k in ("plain", "fence", "scan", "late", "bad", None)] == [(1, 2), (2, 0), (3, 1), (4, None), None, None]
    p = spark.range(1).select(annotate.label_prompt(F.lit("w"), F.lit("1. x"), F.lit("a <b>w</b>")).alias("a"), annotate.sense_prompt(F.lit("w"), F.array(F.lit("t")), F.array(F.lit("k"))).alias("b")).first()
    assert "Word: w" in p.a and "1. x" in p.a and "Known:\nk" in p.b


def test_sinks(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    assert sinks.read_list(spark, p("none")).count() == 0
    for forms in (["b", "a"], ["c", "a", "b"]):
        sinks.write_list(spark.createDataFrame([(f,) for f in forms], "form string"), p("list"), ["form"])
        assert [r.form for r in sinks.read_list(spark, p("list")).collect()] == sorted(forms)
    rows = spark.range(10).select((9 - F.col("id")).alias("id"))
    sinks.write_shards(rows, p("shards"), ["id"], 4)
    assert {r.shard: r["count"] for r in spark.read.parquet(p("shards")).groupBy("shard").count().collect()} == {0: 4, 1: 4, 2: 2}
    forms = spark.createDataFrame([("Ab c", 1, None), ("b", 2, "x"), ("é", 3, None)], "form string, n int, note string")
    sinks.write_items(forms, p("items"), "form")
    assert (tmp_path / "items/item=Ab+c").is_dir() or (tmp_path / "items/item=Ab%2Bc").is_dir()
    sinks.write_export(forms, p("export"))
    assert {r.form: r.bucket for r in spark.read.json(p("export")).collect()} == {"Ab c": "a/ab", "b": "b/b", "é": "special"}
    for at in ("2024-01-31 10:00:00", "2024-02-01 10:00:00"):
        sinks.append_log(forms, p("log"), at)
    assert spark.read.json(p("log")).groupBy("month").count().count() == 2
    a, b = (spark.createDataFrame([(f, t) for f in fs], "form string, updated_at int") for fs, t in (("ab", 1), ("bc", 2)))
    assert sorted(map(tuple, sinks.merged(a, b).collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_text_pieces(spark):
    texts = ["", "abc def gh", "x" * 25, "a  b " * 9, None]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.chunks(F.col("t"), 10).alias("c"))
    for r in d.collect():
        assert "".join(r.c or []) == (r.t or "") and all(0 < len(c) <= 10 for c in r.c or [])
    k = spark.createDataFrame([("1",), (" 3 ",), ("0",), ("",), ("x",)], "k string").select(X.sense_index(F.col("k")).alias("i"))
    assert [r.i for r in k.collect()] == [0, 2, None, None, None]


def test_stored_tables_need_a_shared_folder(spark, monkeypatch):
    path = store.shared_path(spark, "x")
    assert path.startswith(store.shared_root(spark))
    kept = store.stored(spark.range(3), "x")
    assert kept.count() == 3
    store.drop_stored(kept)
    with pytest.raises(Exception):  # noqa: B017
        kept.count()
