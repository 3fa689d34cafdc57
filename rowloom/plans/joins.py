"""Joins that stay even when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A lookup side is broadcast up to this size.
BROADCAST_BYTES = 16 << 20


def is_small(df: DataFrame) -> bool:
    """Whether the optimizer's bound on the size lets a lookup side be broadcast; runs no job.

    File sizes are of compressed columns, hence the bound well below what executors hold. Plans whose size isn't
    known count as large.
    """
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES


def filled(keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).isNotNull()
    return condition


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more rows than a shuffle partition should hold; fewer than there are partitions.

    Rows are counted on the map side first.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, df.count() // partitions)
    counted = df.filter(filled(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counted.filter(F.col("_rows") > share).select(*keys)


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join rows to a table whose keys are unique; ``how`` is ``left`` or ``inner``.

    A small table is broadcast. Otherwise rows with a hot key meet the few table rows
    they need by broadcast, rows without a key are set aside, and only the remaining
    rows, none of whose keys fills a partition, are shuffled.
    """
    keys = list(keys)
    if is_small(right):
        return left.join(F.broadcast(right), keys, how)
    hot = F.broadcast(hot_keys(left, keys))
    complete = left.filter(filled(keys))
    few = right.join(hot, keys, "left_semi")
    by_broadcast = complete.join(hot, keys, "left_semi").join(F.broadcast(few), keys, how)
    by_shuffle = complete.join(hot, keys, "left_anti").join(right, keys, how)
    joined = by_broadcast.unionByName(by_shuffle)
    if how == "inner":
        return joined
    return joined.unionByName(left.filter(~filled(keys)), allowMissingColumns=True)


def without_match(left: DataFrame, right: DataFrame, keys: Sequence[str], hot: DataFrame | None = None) -> DataFrame:
    """Rows with a complete key that the right side lacks; works on streams.

    ``hot`` holds the known frequent keys, few enough to broadcast; a stream can't find
    its own, a table's are counted.
    """
    keys = list(keys)
    complete = left.filter(filled(keys))
    if is_small(right):
        return complete.join(F.broadcast(right), keys, "left_anti")
    if hot is None:
        if left.isStreaming:
            return complete.join(right, keys, "left_anti")
        hot = hot_keys(left, keys)
    hot = F.broadcast(hot)
    few = right.join(hot, keys, "left_semi").distinct()
    by_broadcast = complete.join(hot, keys, "left_semi").join(F.broadcast(few), keys, "left_anti")
    by_shuffle = complete.join(hot, keys, "left_anti").join(right, keys, "left_anti")
    return by_broadcast.unionByName(by_shuffle)
