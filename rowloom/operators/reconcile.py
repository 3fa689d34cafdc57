"""Manifests, fingerprints and reconciliation of expected against actual data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.text import number_text
from rowloom.operators.keys import duplicate_totals
from rowloom.operators.profile import row_counts
from rowloom.plans.catalog import union_all


def build_manifest(tables: Mapping[str, DataFrame], seed: int, mode: str, layer: str) -> DataFrame:
    """Row counts per table with the settings that produced them."""
    return row_counts(tables).select(
        "table_name", "row_count", F.lit(seed).alias("seed"), F.lit(mode).alias("mode"), F.lit(layer).alias("layer")
    )


def schema_signature(catalog: DataFrame) -> DataFrame:
    """16 hex digits over the ordered ``column:type`` names, per table.

    A table has at most a few hundred columns, which bounds the collected list.
    """
    entry = F.struct("ordinal", F.concat_ws(":", "column_name", "data_type").alias("text"))
    names = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"])
    return catalog.groupBy("table_name").agg(
        F.substring(F.sha2(F.concat_ws("|", "table_name", F.concat_ws("|", names)), 256), 1, 16).alias("signature"),
        F.max("row_count").alias("row_count"),
    )


def _row_digest(df: DataFrame):
    cells = []
    for f in df.schema.fields:
        value = F.col(f"`{f.name}`")
        text = number_text(value, f.dataType) if isinstance(f.dataType, T.NumericType) else value.cast("string")
        # The length tells cells apart, whatever they hold; a null has none.
        cells.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.md5(F.concat_ws("|", *cells))


def table_fingerprint(df: DataFrame, table: str) -> DataFrame:
    """Content fingerprint that ignores row order and file layout.

    Two independent slices of each row's digest are combined, one by sum and one by
    exclusive or, so that neither repeated nor swapped rows cancel out.
    """
    digests = df.select(_row_digest(df).alias("d"))
    halves = digests.select(
        F.conv(F.substring("d", 1, 8), 16, 10).cast("bigint").alias("left"),
        F.conv(F.substring("d", 9, 15), 16, 10).cast("bigint").alias("right"),
    )
    return halves.agg(
        F.lit(table).alias("table_name"),
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(F.col("left").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest_sum"),
        F.coalesce(F.bit_xor("right"), F.lit(0)).alias("digest_xor"),
    )


def reconcile_counts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Tables whose count differs from the manifest, missing ones included."""
    a = actual.select("table_name", F.col("row_count").alias("actual_rows"))
    e = expected.select("table_name", F.col("row_count").alias("expected_rows"))
    return (
        e.join(a, "table_name", "left")
        .withColumn("missing", F.col("actual_rows").isNull())
        .withColumn("actual_rows", F.coalesce("actual_rows", F.lit(0)))
        .filter(F.col("missing") | (F.col("actual_rows") != F.col("expected_rows")))
    )


def manifest_check(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Status of every table of the manifest or the data; both need ``signature``."""
    e = expected.select(
        "table_name", F.col("row_count").alias("expected_rows"), F.col("signature").alias("expected_signature")
    )
    a = actual.select(
        "table_name", F.col("row_count").alias("actual_rows"), F.col("signature").alias("actual_signature")
    )
    status = (
        F.when(F.col("actual_rows").isNull(), "no data found")
        .when(F.col("expected_rows").isNull(), "not in manifest")
        .when(F.col("actual_rows") != F.col("expected_rows"), "row count mismatch")
        .when(F.col("actual_signature") != F.col("expected_signature"), "signature mismatch")
        .otherwise("ok")
    )
    return e.join(a, "table_name", "full_outer").select("table_name", "expected_rows", "actual_rows", status.alias("status"))


def missing_columns(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Columns of the expected catalog that the actual one lacks."""
    return expected.join(actual.select("table_name", "column_name"), ["table_name", "column_name"], "left_anti")


def run_reconciliation(
    expected: DataFrame, expected_catalog: DataFrame, tables: Mapping[str, DataFrame], actual_catalog: DataFrame,
    keys: Mapping[str, Sequence[str]],
) -> DataFrame:
    """All findings in one long table: finding, table, detail, amount."""
    counts = reconcile_counts(expected, row_counts(tables)).select(
        F.when(F.col("missing"), "missing_table").otherwise("row_count_diff").alias("finding"),
        "table_name",
        F.lit("").alias("detail"),
        (F.col("actual_rows") - F.col("expected_rows")).alias("amount"),
    )
    present = actual_catalog.select("table_name").distinct()
    columns = missing_columns(expected_catalog.join(present, "table_name", "left_semi"), actual_catalog).select(
        F.lit("missing_column").alias("finding"), "table_name", F.col("column_name").alias("detail"),
        F.lit(1).cast("bigint").alias("amount"),
    )
    duplicates = union_all([duplicate_totals(tables[t], t, key) for t, key in keys.items()]).select(
        F.lit("duplicate_primary_key").alias("finding"), "table_name", F.lit("").alias("detail"),
        F.col("duplicate_keys").alias("amount"),
    ).filter("amount > 0")
    return union_all([counts, columns, duplicates])


def load_check(source: Mapping[str, DataFrame], loaded: Mapping[str, DataFrame]) -> DataFrame:
    """Rows sent against rows read back, per table; a table that was not loaded counts zero."""
    s = row_counts(source).withColumnRenamed("row_count", "source_rows")
    t = row_counts(loaded).withColumnRenamed("row_count", "loaded_rows")
    joined = s.join(t, "table_name", "left")
    return joined.select(
        "table_name", "source_rows", F.coalesce("loaded_rows", F.lit(0)).alias("loaded_rows"),
        F.col("loaded_rows").isNull().alias("missing"),
        F.coalesce(F.col("source_rows") == F.col("loaded_rows"), F.lit(False)).alias("matches"),
    )
