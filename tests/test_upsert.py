"""Upserts: results against brute force, and what is shuffled."""

import random

from lexspark.operators import state


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_upsert_by_place_shuffles_once(spark):
    rnd = random.Random(5)
    some = lambda *x: rnd.choice(x)
    row = lambda s: (some("f", "g", None), some(1, 2, 3, None), some(0, 5, 70_000, 140_000, None), s, some(0, 1, None))
    base, change = [row("old") for _ in range(120)], [row("new") for _ in range(25)]
    df = lambda x: spark.createDataFrame(x, "form string, doc_id long, byte_offset long, sense_key string, rating int")
    got = state.upsert(df(base), df(change), state.KEY)
    replaced = {r[:3] for r in change if None not in r[:3]}
    want = [r for r in base if r[:3] not in replaced] + change
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    plan = _plan(got).split("Initial Plan")[0]
    assert "Join" not in plan and plan.count("Exchange hash") == 1 and "sense_key" in got.columns


def test_upsert_by_another_key(spark):
    df = lambda *x: spark.createDataFrame(x, "id string, n long")
    got = state.upsert(df(("a", 1), ("b", 2), (None, 3)), df(("b", 5), (None, 6)), ["id"])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [("a", 1), (None, 3), ("b", 5), (None, 6)]))
