"""Column catalogs: one row per table column, measured from data or taken from a spec."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.plans.spec import DatasetSpec

DECLARED_SCHEMA = (
    "table_name string, ordinal int, column_name string, data_type string, "
    "nullable boolean, primary_key boolean, hint string"
)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def measured_catalog(tables: Mapping[str, DataFrame]) -> DataFrame:
    """A row per column from one aggregation pass per table.

    Tables are united while they still are one row each and unpivoted afterwards, so
    whatever is computed per column later is planned once, not once per table.
    """
    return (
        union_all([_measure(name, df) for name, df in tables.items()])
        .select("table_name", "row_count", F.explode("entries").alias("e"))
        .select(
            "table_name", "e.ordinal", "e.column_name", "e.data_type", "row_count",
            (F.col("row_count") - F.col("e.filled")).alias("null_count"),
        )
    )


def _measure(name: str, df: DataFrame) -> DataFrame:
    # SQL text instead of column objects: one parse for a table of any width.
    entries = ", ".join(
        f"named_struct('ordinal', {i}, 'column_name', '{f.name}', 'data_type', '{f.dataType.simpleString()}', "
        f"'filled', count(`{f.name}`))"
        for i, f in enumerate(df.schema.fields)
    )
    return df.agg(
        F.expr(f"'{name}' AS table_name"), F.expr("count(1) AS row_count"), F.expr(f"array({entries}) AS entries")
    )


def schema_catalog(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name, ordinal, column_name, data_type`` of every column, from the schemas alone; reads no table.

    A dataset has at most a few thousand columns, which bounds this local table.
    """
    rows = [
        (name, i, f.name, f.dataType.simpleString())
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, data_type string")


def counted_catalog(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The schema catalog with ``row_count``; tables are counted without reading any column."""
    counts = union_all(
        [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()]
    )
    return schema_catalog(tables).join(counts, "table_name")


def declared_catalog(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    """The spec as rows. Duplicate names are kept, so that they can be reported."""
    rows = [
        (t.name, i, c.name, c.type, c.nullable, c.name in t.primary_key, c.hint)
        for t in spec.tables
        for i, c in enumerate(t.columns)
    ]
    return spark.createDataFrame(rows, DECLARED_SCHEMA)
