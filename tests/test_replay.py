"""Replay of a log and segmentation: results against brute force, and what is read and shuffled."""

import random
import re

from pyspark.sql import functions as F

from lexspark.operators import index, state
from lexspark.plans.catalogue import QUERIES


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _write(spark, tmp_path):
    rows = [(i, " ".join(["Lexicon", "the", "of", "§"][(i * k) % 4] for k in range(400)), f"s{i % 3}") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")


def _low(*order):
    """A key by which null is lowest."""
    return tuple((x is not None, x) for x in order)


def test_replay_sends_deletes_and_shuffles_upserts_once(spark):
    rnd = random.Random(8)
    some = lambda *x: rnd.choice(x)
    rows = [(some("f", "g", None), some(1, 2, None), some(0, 70_000), "upsert", some("a", "b", None), some(1, 2, 3, 4, None), some(1, 2, None)) for _ in range(400)]
    rows += [(None, None, None, "delete_by_sense", "a", 3, 1), (None, None, None, "delete_by_sense", "a", 2, 2), ("g", None, None, "delete_by_form", None, 4, 1)]
    last = {}
    for *key, kind, sense, at, seq in rows:
        if kind == "upsert":
            last[tuple(key)] = max(last.get(tuple(key), ()), (_low(at, seq), _low(sense), sense))
    later = lambda kind, i, v: max((_low(at, seq) for *r, at, seq in rows if r[3] == kind and r[i] == v), default=())
    want = [(*k, s) for k, (o, _, s) in last.items() if (s is None or o > later("delete_by_sense", 4, s)) and (k[0] is None or o > later("delete_by_form", 0, k[0]))]
    events = spark.createDataFrame(rows, "form string, doc_id long, byte_offset long, kind string, sense_key string, at int, seq int").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = state.replay(events)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
        plan = _plan(got).split("Initial Plan")[0]
        assert "SortMergeJoin" not in plan and plan.count("Exchange hash") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_events_are_made_in_one_pass(spark, tmp_path):
    _write(spark, tmp_path)
    assert _plan(QUERIES["event_replay"](spark, str(tmp_path))).count("tokens-") == 1


def test_segments_are_cut_from_batches(spark, monkeypatch):
    texts = ["", None, " \t", "ab " * 333, "x" * 90 + "é,漢 𝒳", " \n".join(f"w{i}é" for i in range(500))]
    want = [(i, k, m[1], len(x[: m.start(1)].encode())) for i, x in enumerate(texts) for k, m in enumerate(re.finditer(r"[ \t\n\x0b\f\r]*([^\W_]+|[^ \t\n\x0b\f\r])", x or ""))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(index, "BLOCK", 700)
    parts = index.segments(docs)
    assert "MapInArrow" in _plan(parts) and parts.agg(F.max(F.size("forms"))).first()[0] == index.CHUNK
    assert sorted((r.doc_id, r.pos, r.form, r.byte_offset) for r in index.tokens_of(parts).collect()) == want
