"""Repeated events are found by their hashes: results against brute force, and what is shuffled."""

from pyspark.sql import functions as F

from lexspark.operators import versions
from lexspark.streaming import events as E


def test_repeated_ids_are_dropped_and_the_rest_is_not_shuffled(spark, monkeypatch):
    row = lambda i, sense="a#1", at=1: (f"e{i}", "upsert", "a", i, 0, sense, at, 0)
    none = versions.empty(spark, E.TABLES["seen"].schema)
    once = spark.createDataFrame([row(i) for i in range(500)], E.EVENT)
    got = E._unrepeated(once, none)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 500
    monkeypatch.setattr(E, "PACKED", 7)
    x = spark.createDataFrame([row(i % 300) for i in range(500)] + [row(7, "a#2", 5)], E.EVENT).repartition(5)
    seen = spark.createDataFrame([(f"e{i}", 1) for i in range(250, 1000)], E.TABLES["seen"].schema)
    assert sorted(r.event_id for r in E._unrepeated(x, none).collect()) == sorted(f"e{i}" for i in range(300))
    assert sorted(r.event_id for r in E._unrepeated(x, seen).collect()) == sorted(f"e{i}" for i in range(250))


def test_hashes_that_meet_do_not_drop_events(spark, monkeypatch):
    monkeypatch.setattr(E.F, "xxhash64", lambda *c: F.crc32(F.substring(*c, 1, 2)).cast("long"))  # ten hashes in all
    rows = [(f"{i}|{i % 90}", "upsert", "a", i % 90, 0, "a#1", 1, 0) for i in range(200)]
    x = spark.createDataFrame(rows + rows[:40], E.EVENT).repartition(3)
    got = E._unrepeated(x, versions.empty(spark, E.TABLES["seen"].schema))
    assert sorted(r.event_id for r in got.collect()) == sorted(r[0] for r in rows)


def test_labels_from_repeated_events(spark, tmp_path):
    up = lambda i, form, doc, sense, at, seq=0: (i, "upsert", form, doc, 10, sense, at, seq)
    rows = [up("1", "a", 1, "a#1", 1), up("2", "a", 1, "a#2", 2), up("2", "a", 1, "a#2", 2), up("3", "b", 1, "b#1", 4, 1), up("4", "b", 1, "b#2", 4, 2), up("5", "c", 2, "c#1", 1), up("6", "d", 3, "d#1", 1), up("7", "d", 3, "d#9", 1)]
    rows += [("8", "delete_by_form", "c", None, None, None, 3, 0), ("8", "delete_by_form", "c", None, None, None, 3, 0), ("9", "delete_by_sense", None, None, None, "a#1", 3, 0)]
    spark.createDataFrame(rows, E.EVENT).repartition(4).write.parquet(f"{tmp_path}/in/f0")
    store = E.follow(spark, f"{tmp_path}/in/*", f"{tmp_path}/store")
    want = [("a", 1, 10, "a#2"), ("b", 1, 10, "b#2"), ("d", 3, 10, "d#9")]
    assert sorted(map(tuple, store.table("labels").collect())) == want
    assert store.table("seen").count() == 9
    spark.createDataFrame([rows[0], up("10", "c", 2, "c#2", 9), rows[4]], E.EVENT).write.parquet(f"{tmp_path}/in/f1")
    store = E.follow(spark, f"{tmp_path}/in/*", f"{tmp_path}/store")
    assert sorted(map(tuple, store.table("labels").collect())) == sorted([*want, ("c", 2, 10, "c#2")])
    assert store.table("seen").count() == 10
