"""Structural findings about a dataset, from its column catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.plans.catalog import union_all


def schema_lint(catalog: DataFrame, keys: DataFrame, links: DataFrame) -> DataFrame:
    """Duplicate columns, and keys or links that name tables or columns that don't exist.

    ``keys`` holds ``(table_name, column_name)`` and ``links``
    ``(table_name, column_name, parent_table, parent_column)``.
    """
    columns = catalog.select("table_name", "column_name").distinct()
    tables = catalog.groupBy("table_name").agg(F.max("row_count").alias("row_count"))

    def finding(kind: str, df: DataFrame, table: str, subject, fix: str) -> DataFrame:
        return df.select(
            F.lit(kind).alias("finding"), F.col(table).alias("table_name"), subject.alias("subject"),
            F.lit(fix).alias("fix"),
        )

    repeated = (
        catalog.groupBy("table_name", "column_name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    )
    parents = links.select(F.col("parent_table").alias("table_name"), F.col("parent_column").alias("column_name"))
    found = union_all(
        [
            finding("duplicate_column", repeated, "table_name", F.col("column_name"), "rename or remove the column"),
            finding(
                "dangling_key", keys.join(columns, ["table_name", "column_name"], "left_anti"), "table_name",
                F.col("column_name"), "add the column or drop it from the key",
            ),
            finding(
                "dangling_link_column",
                links.join(columns, ["table_name", "column_name"], "left_anti"), "table_name",
                F.col("column_name"), "add the column or fix the link",
            ),
            finding(
                "dangling_parent_table", parents.join(tables, "table_name", "left_anti"), "table_name",
                F.col("column_name"), "create the table or fix the link",
            ),
            finding(
                "dangling_parent_column",
                parents.join(tables, "table_name", "left_semi").join(
                    columns, ["table_name", "column_name"], "left_anti"
                ),
                "table_name", F.col("column_name"), "add the column or fix the link",
            ),
            finding(
                "self_reference", links.filter("table_name = parent_table"), "table_name", F.col("column_name"),
                "check that the self-reference is meant",
            ),
        ]
    )
    return found.join(tables, "table_name", "left").select(
        "finding", "table_name", "subject", "fix", F.coalesce("row_count", F.lit(0)).alias("affected_rows")
    )
