"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm._common import drop_stored, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Large-star and small-star contractions alternate until the edges stop changing; all state
    stays in tables of the shared folder, and only two numbers a round come to the driver.
    Nodes without an edge do not occur in the result; repeated edges and loops are harmless.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        hung = both.join(low, "a").select("a", "b", F.least("a", "m").alias("m"))
        if large:
            return hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = low.select(F.col("a"), F.least("a", "m").alias("b"))
        return hung.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(own)

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while (seen := mark(now)) != last and seen[0]:
        last = seen
        after = stored(star(star(now, True).distinct(), False).distinct(), "edges")
        drop_stored(now)
        now = after
    tree = now.groupBy("a").agg(F.min("b").alias("b"))
    roots = tree.select(F.col("b").alias("node")).distinct()
    return tree.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
