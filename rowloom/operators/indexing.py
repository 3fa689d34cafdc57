"""Dense row positions for tables that have none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.plans.scratch import settle

POSITION_BITS = 33


def dense_index(df: DataFrame, order_by: Sequence[Column | str], name: str = "row_idx") -> DataFrame:
    """Add ``0 .. n-1`` in the given total order without a single-task window.

    The table is range-partitioned and sorted by all tasks, settled once so that
    partition contents can't change between the two passes, and each partition's
    start is the row count of those before it. The offsets hold one row per
    partition, which bounds the broadcast.
    """
    ordered = settle(df.orderBy(*order_by))
    placed = ordered.withColumn("_part", F.spark_partition_id()).withColumn(
        "_within", F.monotonically_increasing_id().bitwiseAND((1 << POSITION_BITS) - 1)
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    )
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_within"))
        .drop("_part", "_within", "_start")
    )
