"""Dense ranks within groups that may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spread_rank(rows: DataFrame, group: list[str], order: str, ties: list[str], name: str = "rank", bits: int = 10) -> DataFrame:
    """Adds a rank from 0 within each group, in order of the long column ``order``, then of ``ties``.

    A group is cut at fixed places of the order, uniform 64-bit hashes say,
    into 2**bits slices.  Rows are numbered within slices, and slices begin
    where the counts before them end, so no task gets a whole group.
    """
    sliced = rows.withColumn("_slice", F.shiftright(order, 64 - bits))
    counts = sliced.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    # at most 2**bits rows of a group
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*group, "_slice").orderBy(order, *ties)
    return sliced.withColumn("_row", F.row_number().over(within)).join(bases, [*group, "_slice"]).withColumn(name, F.col("_base") + F.col("_row") - 1).drop("_slice", "_row", "_base")
