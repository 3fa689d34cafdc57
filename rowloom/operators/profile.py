"""Null profiles, dataset totals, schema compliance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.shapes import half_up
from rowloom.plans.catalog import union_all


def ratio(part: str, whole: str):
    """``part / whole`` with four decimals; zero for an empty whole."""
    share = F.col(part).cast("double") / F.col(whole).cast("double")
    return F.when(F.col(whole) > 0, half_up(share, 4)).otherwise(F.lit(0.0))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return union_all(
        [df.agg(F.expr(f"'{name}' AS table_name"), F.expr("count(1) AS row_count")) for name, df in tables.items()]
    )


def table_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, columns, nulls and null ratio; one aggregation pass per table."""
    counted = union_all([_profile(name, df) for name, df in tables.items()])
    cells = F.col("row_count") * F.col("column_count")
    return counted.withColumn("cell_count", cells).withColumn("null_ratio", ratio("null_count", "cell_count")).drop(
        "cell_count"
    )


def _profile(name: str, df: DataFrame) -> DataFrame:
    width = len(df.columns)
    filled = " + ".join(f"count(`{c}`)" for c in df.columns) or "0L"
    return df.agg(F.expr("count(1) AS row_count"), F.expr(f"{filled} AS filled")).selectExpr(
        f"'{name}' AS table_name",
        "row_count",
        f"{width} AS column_count",
        f"row_count * {width} - filled AS null_count",
    )


def dataset_summary(profiles: DataFrame) -> DataFrame:
    totals = profiles.agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("total_tables"),
        F.coalesce(F.sum("null_count"), F.lit(0)).alias("total_nulls"),
        F.coalesce(F.sum(F.col("row_count") * F.col("column_count")), F.lit(0)).alias("total_cells"),
    )
    return totals.withColumn("overall_null_ratio", ratio("total_nulls", "total_cells"))


def schema_compliance(df: DataFrame, table: str, expected: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Columns outside the declaration and nulls in required columns, with affected rows."""
    rows = F.count(F.lit(1))
    findings = [("unexpected_column", c, rows) for c in df.columns if c not in expected]
    for column in required:
        missing = F.count_if(F.col(column).isNull()) if column in df.columns else rows
        findings.append(("required_null", column, missing))
    if not findings:
        findings = [("none", "", F.lit(0).cast("bigint"))]
    totals = df.agg(*[value.alias(f"n_{i}") for i, (_, _, value) in enumerate(findings)])
    entries = [
        F.struct(F.lit(kind).alias("finding"), F.lit(column).alias("column_name"), F.col(f"n_{i}").alias("rows"))
        for i, (kind, column, _) in enumerate(findings)
    ]
    return (
        totals.select(F.explode(F.array(*entries)).alias("e"))
        .select(F.lit(table).alias("table_name"), "e.finding", "e.column_name", F.col("e.rows").alias("affected_rows"))
        .filter(F.col("affected_rows") > 0)
    )


def validity_score(total_rows: DataFrame, errors: DataFrame) -> DataFrame:
    """``max(0, 1 - errors / max(rows, 1) * 0.1)`` from two one-row frames
    (``total_rows``) and (``reference_errors``)."""
    both = total_rows.select("total_rows", F.lit(0).cast("bigint").alias("reference_errors")).unionByName(
        errors.select(F.lit(0).cast("bigint").alias("total_rows"), "reference_errors")
    )
    summed = both.agg(F.sum("total_rows").alias("total_rows"), F.sum("reference_errors").alias("reference_errors"))
    loss = F.col("reference_errors") / F.greatest(F.col("total_rows"), F.lit(1)) * F.lit(0.1)
    return summed.withColumn("schema_validity_score", F.greatest(F.lit(0.0), F.lit(1.0) - loss))
