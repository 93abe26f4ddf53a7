"""Places in a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.operators.store import stored

#: monotonically_increasing_id() keeps the partition above this bit and the row's place below it.
PART_BIT = 33


def numbered(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """rows with their place in the order, from 0, as name.

    Rows are range-partitioned by the order and sorted there; a partition's first place is the sum
    of the counts before it, one row a partition. The ranges come from a sample, which need not be
    drawn alike twice, so the sorted rows are stored before they are counted. Rows that the
    order leaves tied get places in any order among themselves.
    """
    at = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    at = at.withColumn("_p", F.shiftright("_m", PART_BIT))
    n = at.groupBy("_p").agg(F.count("*").alias("_n"))
    first = n.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_first"))
    place = F.col("_first") + F.col("_m").bitwiseAND((1 << PART_BIT) - 1)
    return at.join(F.broadcast(first), "_p").select(*rows.columns, place.alias(name))


def running(rows: DataFrame, order: list[str | Column], sums: dict[str, str]) -> DataFrame:
    """rows with running sums, in the order, up to and with each row: a column for each name, of the column it stands for.

    Like numbered(): sums are formed within ranges of the order, and those of the ranges before are
    added, one row a range; no task sees more than a range. Rows that the order leaves tied are
    summed in any order among themselves, and if many rows tie, they are one range: group such
    rows before.
    """
    at = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "running")
    at = at.withColumn("_p", F.shiftright("_m", PART_BIT))
    whole = at.groupBy("_p").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    before = whole.select("_p", *[(F.sum(f"_{k}").over(Window.orderBy("_p")) - F.col(f"_{k}")).alias(f"_{k}") for k in sums])
    own = Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return at.join(F.broadcast(before), "_p").select(*rows.columns, *[(F.col(f"_{k}") + F.sum(c).over(own)).alias(k) for k, c in sums.items()])
