"""Duplicate keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.plans.joins import filled


def repeated_rows(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Every row that repeats an earlier row's key; rows with a null key never do.

    The first row of each key comes from a map-side combined minimum. All other rows
    are what is left after removing those first rows by key *and* order value, so
    rows of a hot key spread over all tasks. ``order`` must be unique.
    """
    keyed = df.filter(filled(key))
    first = keyed.groupBy(*key).agg(F.min(order).alias(order))
    return keyed.join(first, [*key, order], "left_anti")


def repeated_keys(df: DataFrame, key: Sequence[str], ignore_null: bool = False) -> DataFrame:
    """Keys held by more than one row, with the number of rows."""
    rows = df.filter(filled(key)) if ignore_null else df
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("key_rows")).filter("key_rows > 1")


def duplicate_totals(df: DataFrame, table: str, key: Sequence[str], ignore_null: bool = False) -> DataFrame:
    """Keys held more than once and the rows beyond the first of each."""
    return repeated_keys(df, key, ignore_null).agg(
        F.lit(table).alias("table_name"),
        F.count(F.lit(1)).alias("duplicate_keys"),
        F.coalesce(F.sum(F.col("key_rows") - 1), F.lit(0)).alias("duplicate_rows"),
    )
