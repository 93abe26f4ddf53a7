"""Places in a total order against a sort on one machine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lexspark.operators import ranking, stats, work
from lexspark.operators.ranking import numbered


def test_places_follow_the_order(spark):
    rows = [(f"w{i * 7919 % 997}", i * 31 % 13) for i in range(997)]
    df = spark.createDataFrame(rows, "form string, total int").repartition(8)
    got = {(r.form, r.total): r.n for r in numbered(df, [F.desc("total"), "form"], "n").collect()}
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert got == {r: i for i, r in enumerate(want)}


def test_a_value_that_most_rows_share(spark):
    rows = [(1 if i % 10 else 2, i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    got = [(r.a, r.b) for r in numbered(df, ["a", "b"], "n").orderBy("n").collect()]
    assert got == sorted(rows)


def test_ties_nulls_and_nothing(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "form string")
    got = sorted((r.n, r.form) for r in numbered(df, ["form"], "n").collect())
    assert got == [(0, None), (1, "a"), (2, "a")]
    assert numbered(df.where("false"), ["form"], "n").count() == 0


def test_running_sums_and_quantiles(spark):
    rows = [(i % 7, i, float(i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, i long, v double").repartition(5)
    got = {r.i: (r.s, r.n) for r in ranking.running(df.withColumn("one", F.lit(1)), ["k", F.desc("i")], {"s": "v", "n": "one"}).collect()}
    total = 0.0
    for n, (_, i, v) in enumerate(sorted(rows, key=lambda r: (r[0], -r[1])), 1):
        total += v
        assert got[i] == (total, n)
    for values in ([], [3.0], [1.0, 2.0], [5.0] * 50 + [1.0, 9.0], [float(x * x % 31) for x in range(40)]):
        p = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
        want = [float(np.quantile(values, q)) if values else None for q in (0.0, 0.3, 0.5, 0.8, 1.0)]
        assert np.allclose(np.array(stats.quantiles(p, "x", [0.0, 0.3, 0.5, 0.8, 1.0]), float), np.array(want, float), equal_nan=True)


def test_no_window_without_a_partition(spark):
    """Orders over a whole table run over ranges; only one row a range is seen by one task."""
    df = spark.createDataFrame([(f"f{i}", float(i % 9 + 1), i % 13 + 1) for i in range(200)], "form string, weight double, avail long")
    for out in (work.allocate(df, 300), stats.spearman(df, "weight", "avail")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan or all("_p" in x for x in plan.split("\n") if "Window [" in x)
    assert sum(r.n for r in work.allocate(df, 300).collect()) <= 300
