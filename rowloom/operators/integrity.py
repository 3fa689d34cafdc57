"""Referential integrity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.plans.catalog import union_all
from rowloom.plans.joins import filled, without_match
from rowloom.plans.spec import ForeignKey


def orphan_values(
    child: DataFrame, child_columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]
) -> DataFrame:
    """Foreign-key values without a parent and the child rows that hold them.

    Child rows are counted per value before the join, on the map side first, so a
    value held by a third of the rows is one row in the join.
    """
    held = child.filter(filled(child_columns)).groupBy(*child_columns).agg(F.count(F.lit(1)).alias("child_rows"))
    keys = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(parent_columns)])
    match = [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(child_columns)]
    return held.join(keys, match, "left_anti")


def ref_integrity(tables: Mapping[str, DataFrame], foreign_keys: Sequence[ForeignKey]) -> DataFrame:
    """One row per foreign key: orphan rows, distinct orphan values, verdict."""
    return union_all([_one(tables, fk) for fk in foreign_keys])


def _one(tables: Mapping[str, DataFrame], fk: ForeignKey) -> DataFrame:
    orphans = orphan_values(tables[fk.child], fk.child_columns, tables[fk.parent], fk.parent_columns)
    return orphans.agg(
        F.lit(fk.name).alias("foreign_key"),
        F.coalesce(F.sum("child_rows"), F.lit(0)).alias("orphan_rows"),
        F.count(F.lit(1)).alias("orphan_values"),
        F.min(F.concat_ws("|", *[F.col(c).cast("string") for c in fk.child_columns])).alias("sample_value"),
    ).withColumn("intact", F.col("orphan_rows") == 0)


def orphan_rows(
    child: DataFrame, child_columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]
) -> DataFrame:
    """All child rows without a parent; frequent foreign keys are not gathered in one task."""
    keys = parent.select(*[F.col(p).alias(c) for c, p in zip(child_columns, parent_columns)])
    return without_match(child, keys, child_columns)


def orphan_samples(
    tables: Mapping[str, DataFrame], foreign_keys: Sequence[ForeignKey], keys: Mapping[str, Sequence[str]], per_key: int = 5
) -> DataFrame:
    """Of every foreign key the first orphan rows in the order of their own key: ``foreign_key, sample_no, row_key, value, message``.

    ``keys`` names the key columns of the child tables. Every task sends its first rows only, so the sample costs what finding the
    orphans costs, however many there are. Rows of equal keys come in the order of their foreign key; a null in a row key
    shows as nothing.
    """
    return union_all([_samples(tables, fk, list(keys[fk.child]), per_key) for fk in foreign_keys])


def _samples(tables: Mapping[str, DataFrame], fk: ForeignKey, key: list[str], per_key: int) -> DataFrame:
    def shown(columns: Sequence[str]) -> Column:
        return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])

    orphans = orphan_rows(tables[fk.child], fk.child_columns, tables[fk.parent], fk.parent_columns)
    order = [*key, *(c for c in fk.child_columns if c not in key)]
    first = orphans.select(*order).orderBy(*order).limit(per_key)
    numbered = first.withColumn("sample_no", F.row_number().over(Window.orderBy(*order)))
    named, parent = f"{fk.child}.{','.join(fk.child_columns)}", fk.parent
    return numbered.select(
        F.lit(fk.name).alias("foreign_key"), "sample_no", shown(key).alias("row_key"), shown(fk.child_columns).alias("value"),
        F.concat(F.lit(f"{named} of row "), shown(key), F.lit(" is "), shown(fk.child_columns), F.lit(f", which {parent} lacks")).alias("message"),
    )


def intact(report: DataFrame) -> bool:
    """Overall verdict of a report; a report holds one row per foreign key."""
    return report.filter(~F.col("intact")).isEmpty()
