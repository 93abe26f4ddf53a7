"""Tables too large to be sent are met by hash first: results, and that not all tokens are shuffled."""

import pytest

from pyspark.sql import functions as F

from lexspark.operators import mwe, store


@pytest.fixture
def unsent(spark, monkeypatch):
    monkeypatch.setattr(store.sent, "__defaults__", (-1,))
    monkeypatch.setattr(store, "_ROWS", {})
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _tokens(spark):
    words = ("hot dog in the park . " * 12 + " ".join(f"w{i}" for i in range(300)) + " Hot dog").split()
    return spark.createDataFrame([(d, i, w, *(words[i + 1 : i + 3] + [None, None])[:2]) for d in (1, 2) for i, w in enumerate(words)], "doc_id long, byte_offset long, form string, w2 string, w3 string")


@pytest.mark.parametrize("most", [store.MOST_HASHES, 0])
def test_pairs_and_places_without_a_broadcast_of_words(spark, unsent, monkeypatch, most):
    monkeypatch.setattr(store, "MOST_HASHES", most)
    t = _tokens(spark)
    pairs = mwe.pmi(t, min_pmi=-1e9)
    assert {r.form: r["count"] for r in pairs.collect()} == {"hot dog": 24, "dog in": 24, "in the": 24, "the park": 24}
    want = spark.createDataFrame([("hot dog", ["hot", "dog"]), ("in the park", ["in", "the", "park"]), ("the dog", ["the", "dog"])], "form string, components array<string>")
    found = mwe.find(t, want)
    assert found.groupBy("form").count().orderBy("form").collect() == [("hot dog", 24), ("in the park", 24)]
    assert mwe.find(t, want, lower=True).where("form = 'hot dog'").count() == 26
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (pairs, found)]
    if most:
        assert all("BroadcastHashJoin" in p and "LeftSemi" in p for p in plans)
        assert not any("SortMergeJoin" in line and "LeftSemi" in line for p in plans for line in p.splitlines())


def test_new_rows_keep_repeats_and_nulls(spark):
    found = spark.createDataFrame([("a", 1, 0), ("a", 1, 0), ("a", 2, 0), (None, 1, 5), ("b", 1, 70000)], "form string, doc_id long, byte_offset long")
    index = found.where(F.col("doc_id") == 2).unionByName(found.where("form is null or form = 'b'"))
    assert sorted(map(str, mwe.new_rows(found, index).collect())) == sorted(map(str, found.where("doc_id = 1 and (form is null or form = 'a')").collect()))
