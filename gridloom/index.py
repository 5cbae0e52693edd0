"""Dense row numbers for DataFrames, without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RID = "__rid"


def with_row_index(df: DataFrame, order_by: str | list[str], name: str = RID) -> DataFrame:
    """Adds a 1-based dense index in the order of unique keys.

    Rows are dealt out by range of the keys; the sizes of the ranges, a number
    per partition, give each its first index by a prefix sum.  The ranges are
    persisted, so that both passes see the same ones.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *keys).withColumn("__range", F.spark_partition_id()).persist()
    sizes = dict(dealt.groupBy("__range").count().collect())
    base, first = 0, []
    for k in range(n):
        first.append((k, base))
        base += sizes.get(k, 0)
    # a row per partition, so it may be broadcast
    offsets = F.broadcast(df.sparkSession.createDataFrame(first, "__range int, __base long"))
    within = Window.partitionBy("__range").orderBy(*keys)
    numbered = dealt.withColumn("__row", F.row_number().over(within)).join(offsets, "__range")
    return numbered.withColumn(name, (F.col("__row") + F.col("__base")).cast("long")).drop("__range", "__row", "__base")
