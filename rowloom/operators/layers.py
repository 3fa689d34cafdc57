"""Bronze, silver and gold."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.text import blank_to_null, collapse, strip
from rowloom.plans.catalog import union_all


def _map_text(df: DataFrame, changes: Sequence[Callable[[Column], Column]], apart: Mapping[str, Column] | None = None) -> DataFrame:
    """Change every text cell, one change after the other; columns in ``apart`` are replaced by what is given there.

    A change is written once, for an array of a row's cells. Written out per column it makes generated methods
    of more than 8,000 bytes, which the JVM doesn't compile.
    """
    apart = apart or {}
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in apart]
    if not texts:
        return df.withColumns(apart) if apart else df
    changed = reduce(F.transform, changes, F.array(*[F.col(c) for c in texts]))
    staged = df.select(*[apart[c].alias(c) if c in apart else F.col(c) for c in df.columns if c not in texts], changed.alias("_texts"))
    return staged.select(*[F.get("_texts", F.lit(texts.index(c))).alias(c) if c in texts else F.col(c) for c in df.columns])


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def silver_clean(df: DataFrame, key: str) -> DataFrame:
    """Strip text; blanks become null, except in the key."""
    return _map_text(df, [strip, blank_to_null], {key: strip(F.col(key))} if _is_text(df, key) else None)


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row of every key; rows without a key all stay.

    Rows without a key get a group of their own. The rank filter is applied on the
    map side first, so a hot key sends one row per task.
    """
    guard = F.when(F.col(key).isNull(), F.col(order))
    rank = F.row_number().over(Window.partitionBy(F.col(key), guard).orderBy(order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def gold_normalize(df: DataFrame) -> DataFrame:
    """Strip text and collapse inner whitespace."""
    return _map_text(df, [collapse])


def to_layer(df: DataFrame, layer: str, key: str, order: str) -> DataFrame:
    if layer == "bronze":
        return df
    # Only the key decides which rows stay; the other text is cleaned once they are fewer.
    silver = silver_clean(keep_first(df.withColumn(key, strip(F.col(key))) if _is_text(df, key) else df, key, order), key)
    return silver if layer == "silver" else gold_normalize(silver)


def typed(df: DataFrame, types: Mapping[str, str], failures: str = "cast_failures") -> DataFrame:
    """Cast raw text to declared types; a row counts how many filled cells did not parse."""
    columns: list[Column] = []
    failed = F.lit(0)
    for name in df.columns:
        if name not in types:
            columns.append(F.col(name))
            continue
        value = F.col(name)
        parsed = value.try_cast(types[name])
        columns.append(parsed.alias(name))
        failed = failed + (value.isNotNull() & parsed.isNull()).cast("int")
    return df.select(*columns, failed.alias(failures))


def layer_deltas(layers: Mapping[str, Mapping[str, DataFrame]]) -> DataFrame:
    """Rows removed between neighbouring layers, all tables together."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(layer).alias("layer"), "n")
        for layer, tables in layers.items()
        for df in tables.values()
    ]
    totals = union_all(counted).groupBy().agg(
        *[F.sum(F.when(F.col("layer") == name, F.col("n"))).alias(name) for name in ("bronze", "silver", "gold")]
    )
    return totals.select(
        F.greatest(F.lit(0), F.col("bronze") - F.col("silver")).alias("bronze_to_silver_removed"),
        F.greatest(F.lit(0), F.col("silver") - F.col("gold")).alias("silver_to_gold_removed"),
    )
