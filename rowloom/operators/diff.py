"""Differences between schemas, configurations and table versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Changes from the left to the right column catalog, tables and columns.

    A table that is new or gone is one row; only tables on both sides are compared
    column by column. Catalogs carry ``table_name, column_name, data_type`` and may
    carry ``attributes``, text whose change is not a type change.
    """
    extra = "attributes" in left.columns and "attributes" in right.columns
    attributes = F.col("attributes") if extra else F.lit("")
    l = left.select("table_name", "column_name", F.col("data_type").alias("from_type"), attributes.alias("_la"))
    r = right.select("table_name", "column_name", F.col("data_type").alias("to_type"), attributes.alias("_ra"))
    lt = left.select("table_name").distinct().withColumn("_l", F.lit(True))
    rt = right.select("table_name").distinct().withColumn("_r", F.lit(True))
    sides = lt.join(rt, "table_name", "full_outer")
    no_text = F.lit(None).cast("string")
    tables = sides.filter(F.col("_l").isNull() | F.col("_r").isNull()).select(
        F.when(F.col("_r").isNull(), "table_removed").otherwise("table_added").alias("change"),
        "table_name", no_text.alias("column_name"), no_text.alias("from_type"), no_text.alias("to_type"),
    )
    both = sides.filter(F.col("_l").isNotNull() & F.col("_r").isNotNull()).select("table_name")
    change = (
        F.when(F.col("to_type").isNull(), "column_removed")
        .when(F.col("from_type").isNull(), "column_added")
        .when(F.col("from_type") != F.col("to_type"), "column_type_changed")
        .when(F.col("_la") != F.col("_ra"), "column_modified")
    )
    columns = (
        l.join(r, ["table_name", "column_name"], "full_outer")
        .join(both, "table_name", "left_semi")
        .withColumn("change", change)
        .filter(F.col("change").isNotNull())
        .select("change", "table_name", "column_name", "from_type", "to_type")
    )
    return tables.unionByName(columns)


def relationship_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Relationships (column ``relationship``) that appeared or went away."""
    gone = left.join(right, "relationship", "left_anti").select(
        F.lit("relationship_removed").alias("change"), "relationship"
    )
    new = right.join(left, "relationship", "left_anti").select(
        F.lit("relationship_added").alias("change"), "relationship"
    )
    return gone.unionByName(new)


# Changes that break readers of the older schema.
BREAKING = ("table_removed", "column_removed", "column_type_changed", "relationship_removed")


def compatibility(changes: DataFrame) -> DataFrame:
    """Breaking and harmless changes and the overall status."""
    breaking = F.col("change").isin(*BREAKING)
    return changes.agg(
        F.count_if(breaking).alias("breaking_count"), F.count_if(~breaking).alias("non_breaking_count")
    ).withColumn("status", F.when(F.col("breaking_count") > 0, "breaking").otherwise("compatible"))


def flatten_config(df: DataFrame, key: str, config: str, *, keep: Sequence[str] = ()) -> DataFrame:
    """Rows ``(key, *keep, path, value)`` of a JSON configuration column.

    A nested object of plain values is opened one level as ``outer.inner``; one that
    holds further objects or lists stays a single value, as does an array.
    """
    tvf = df.sparkSession.tvf
    top = (
        df.select(key, *keep, F.parse_json(config).alias("_config"))
        .lateralJoin(tvf.variant_explode(F.col("_config").outer()))
        .select(key, *keep, F.col("key").alias("_outer"), F.col("value").alias("_value"))
    )
    shape = F.schema_of_variant("_value")
    plain = shape.startswith("OBJECT<") & ~F.substr(shape, F.lit(8)).rlike("OBJECT<|ARRAY<")
    opened = (
        top.withColumn("_open", plain)
        .withColumn("_inside", F.when(F.col("_open"), F.col("_value")))
        .lateralJoin(tvf.variant_explode_outer(F.col("_inside").outer()).toDF("_pos", "_inner", "_part"))
    )
    return opened.filter(~F.col("_open") | F.col("_inner").isNotNull()).select(
        key, *keep,
        F.concat_ws(".", "_outer", "_inner").alias("path"),
        F.to_json(F.when(F.col("_open"), F.col("_part")).otherwise(F.col("_value"))).alias("value"),
    )


def config_diff(left: DataFrame, right: DataFrame, key: str, config: str) -> DataFrame:
    """Paths whose values differ between two versions of each configuration; keys are unique and not null.

    Versions meet by key alone, and equal texts go at once. Only what is left is opened; both sides of a
    key are then in one task already, so paths need no shuffle of their own.
    """
    l = left.select(key, F.col(config).alias("_l"))
    r = right.select(key, F.col(config).alias("_r"))
    changed = l.join(r, key, "full_outer").filter(~F.col("_l").eqNullSafe(F.col("_r")))
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"_{s}").alias("text")) for s in ("l", "r")])
    texts = changed.select(key, F.explode(sides).alias("s")).select(key, F.col("s.side").alias("_side"), F.col("s.text").alias("_text"))
    values = flatten_config(texts.filter("_text IS NOT NULL"), key, "_text", keep=["_side"])
    return (
        values.groupBy(key, "path")
        .agg(*[F.max(F.when(F.col("_side") == s, F.col("value"))).alias(n) for s, n in (("l", "left_value"), ("r", "right_value"))])
        .filter(~F.col("left_value").eqNullSafe(F.col("right_value")))
    )


def keyed_diff(left: DataFrame, right: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Field-by-field comparison of two versions of a table; one row per key and field.

    Keys must be unique on each side, so the join never multiplies rows.
    """
    def side(df: DataFrame, mark: str) -> DataFrame:
        return df.select(*key, *[F.col(c).cast("string").alias(f"{mark}_{c}") for c in columns])

    joined = side(left, "l").join(side(right, "r"), list(key), "full_outer")
    entries = [
        F.struct(F.lit(c).alias("field"), F.col(f"l_{c}").alias("left_value"), F.col(f"r_{c}").alias("right_value"))
        for c in columns
    ]
    l, r = F.col("left_value"), F.col("right_value")
    status = (
        F.when(l.isNull() & r.isNotNull(), "missing_on_left")
        .when(l.isNotNull() & r.isNull(), "missing_on_right")
        .when(l.eqNullSafe(r), "unchanged")
        .otherwise("changed")
    )
    return (
        joined.select(*key, F.explode(F.array(*entries)).alias("e"))
        .select(*key, "e.field", "e.left_value", "e.right_value")
        .withColumn("status", status)
    )


def diff_summary(fields: DataFrame) -> DataFrame:
    """Fields per status."""
    return fields.groupBy("field", "status").agg(F.count(F.lit(1)).alias("rows"))
