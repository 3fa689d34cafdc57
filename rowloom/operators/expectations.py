"""Expectation suites: derived from specs, evaluated in one pass per table."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.operators.keys import repeated_keys
from rowloom.plans.catalog import union_all
from rowloom.plans.spec import BusinessRule, DatasetSpec

# Expectation names.
ROW_COUNT = "expect_table_row_count_to_be_between"
NOT_NULL = "expect_column_values_to_not_be_null"
UNIQUE = "expect_column_values_to_be_unique"
IN_SET = "expect_column_values_to_be_in_set"
BETWEEN = "expect_column_values_to_be_between"

SUITE_SCHEMA = "suite string, seq int, expectation string, column_name string, kwargs string"
NUMBER_TEXT = r"^[0-9.\-]*[0-9][0-9.\-]*$"


#: Examples per check.
SAMPLES = 5


@dataclass(frozen=True)
class Expectation:
    kind: str
    column: str | None = None
    min_value: float | None = None
    max_value: float | None = None
    value_set: Sequence[str] = ()

    def kwargs(self) -> str:
        content: dict[str, object] = {}
        if self.column is not None:
            content["column"] = self.column
        if self.kind in (ROW_COUNT, BETWEEN):
            content["min_value"], content["max_value"] = self.min_value, self.max_value
        if self.kind == IN_SET:
            content["value_set"] = list(self.value_set)
        return json.dumps(content)


def derive_suite(spec: DatasetSpec, table: str, rules: Sequence[BusinessRule] = ()) -> list[Expectation]:
    """Row count, key, foreign key, enum domain and rule expectations of a table."""
    declared = spec.table(table)
    suite = [Expectation(ROW_COUNT, min_value=1)]
    for name in declared.primary_key:
        suite += [Expectation(NOT_NULL, name), Expectation(UNIQUE, name)]
    linked = dict.fromkeys(c for fk in spec.foreign_keys if fk.child == table for c in fk.child_columns)
    suite += [Expectation(NOT_NULL, c) for c in linked if c not in declared.primary_key]
    suite += [Expectation(IN_SET, c.name, value_set=tuple(c.enum)) for c in declared.columns if c.enum]
    for rule in rules:
        if rule.table != table:
            continue
        if rule.kind == "range" and "min" in rule.params and "max" in rule.params:
            suite += [
                Expectation(BETWEEN, f, min_value=rule.params["min"], max_value=rule.params["max"])
                for f in rule.fields
            ]
        if rule.kind == "enum" and rule.params.get("values"):
            suite += [Expectation(IN_SET, f, value_set=tuple(rule.params["values"])) for f in rule.fields]
    return suite


def suite_rows(spark: SparkSession, suites: Mapping[str, Sequence[Expectation]]) -> DataFrame:
    rows = [
        (f"{table}_suite", i, e.kind, e.column, e.kwargs())
        for table, suite in suites.items()
        for i, e in enumerate(suite)
    ]
    return spark.createDataFrame(rows, SUITE_SCHEMA)


def breaks(df: DataFrame, e: Expectation) -> Column | None:
    """Where a row breaks the expectation; none for row counts and uniqueness."""
    if e.kind not in (NOT_NULL, IN_SET, BETWEEN):
        return None
    if e.column not in df.columns:
        return F.lit(e.kind == NOT_NULL)
    value = F.col(e.column)
    if e.kind == NOT_NULL:
        return value.isNull()
    if e.kind == IN_SET:
        broken = ~value.isin(list(e.value_set)) if e.value_set else value.isNotNull()
        return F.coalesce(broken, F.lit(False))
    number = value
    if dict(df.dtypes)[e.column] == "string":
        number = F.when(value.rlike(NUMBER_TEXT), value.try_cast("double"))
    outside = F.lit(False)
    if e.min_value is not None:
        outside = outside | (number < F.lit(e.min_value))
    if e.max_value is not None:
        outside = outside | (number > F.lit(e.max_value))
    return F.coalesce(outside, F.lit(False))


def failing_rows(df: DataFrame, e: Expectation) -> Column | None:
    """Aggregate that counts what breaks the expectation; none for uniqueness."""
    if e.kind == ROW_COUNT:
        rows = F.count(F.lit(1))
        low = F.lit(0) if e.min_value is None else F.lit(int(e.min_value))
        outside = rows < low
        if e.max_value is not None:
            outside = outside | (rows > F.lit(int(e.max_value)))
        return outside.cast("bigint")
    broken = breaks(df, e)
    return None if broken is None else F.count_if(broken)


def failing_samples(df: DataFrame, table: str, suite: Sequence[Expectation], order: str, per_check: int = SAMPLES) -> DataFrame:
    """The first rows that break each row expectation, and repeated values of unique columns: a report's examples.

    ``suite, seq, expectation, column_name, sample_no, row_key, value``; ``row_key`` is the row's ``order`` column as
    text, null for a repeated value. Rank limits are applied inside every task before the shuffle.
    """
    own = [(i, e) for i, e in enumerate(suite) if breaks(df, e) is not None]
    no_text = F.lit(None).cast("string")
    parts = []
    if own:
        found = F.array(*[
            F.when(breaks(df, e), F.struct(
                F.lit(i).alias("seq"), F.lit(e.kind).alias("expectation"), F.lit(e.column).alias("column_name"),
                (F.col(e.column).cast("string") if e.column in df.columns else no_text).alias("value"),
            ))
            for i, e in own
        ])
        hit = df.select(F.col(order).alias("_order"), F.explode(found).alias("e")).filter("e IS NOT NULL").select("_order", "e.*")
        rank = F.row_number().over(Window.partitionBy("seq").orderBy("_order"))
        parts.append(hit.withColumn("sample_no", rank).filter(F.col("sample_no") <= per_check).withColumn("row_key", F.col("_order").cast("string")))
    for i, e in enumerate(suite):
        if e.kind == UNIQUE and e.column in df.columns:
            again = repeated_keys(df, [e.column]).orderBy(e.column).limit(per_check)
            parts.append(again.select(
                F.lit(i).alias("seq"), F.lit(e.kind).alias("expectation"), F.lit(e.column).alias("column_name"),
                F.col(e.column).cast("string").alias("value"), F.row_number().over(Window.orderBy(e.column)).alias("sample_no"),
                no_text.alias("row_key"),
            ))
    names = ["seq", "expectation", "column_name", "sample_no", "row_key", "value"]
    return union_all([p.select(F.lit(f"{table}_suite").alias("suite"), *names) for p in parts])


def run_suite(df: DataFrame, table: str, suite: Sequence[Expectation]) -> DataFrame:
    """One row per expectation: failing rows (keys for uniqueness) and the verdict.

    All but the uniqueness checks share a single aggregation.
    """
    simple = [(i, e) for i, e in enumerate(suite) if e.kind != UNIQUE]
    parts = []
    if simple:
        totals = df.agg(*[failing_rows(df, e).alias(f"f_{i}") for i, e in simple])
        entries = [
            F.struct(
                F.lit(i).alias("seq"), F.lit(e.kind).alias("expectation"),
                F.lit(e.column).cast("string").alias("column_name"), F.col(f"f_{i}").alias("failing"),
            )
            for i, e in simple
        ]
        parts.append(totals.select(F.explode(F.array(*entries)).alias("e")).select("e.*"))
    for i, e in enumerate(suite):
        if e.kind == UNIQUE:
            known = e.column in df.columns
            # Of a missing column every value is null, so that two rows repeat it.
            failing = F.count(F.lit(1)) if known else (F.count(F.lit(1)) > 1).cast("bigint")
            parts.append(
                (repeated_keys(df, [e.column]) if known else df).agg(
                    F.lit(i).alias("seq"), F.lit(e.kind).alias("expectation"),
                    F.lit(e.column).alias("column_name"), failing.alias("failing"),
                )
            )
    return union_all(parts).select(
        F.lit(f"{table}_suite").alias("suite"), "seq", "expectation", "column_name", "failing",
        (F.col("failing") == 0).alias("passed"),
    )


def run_suites(
    tables: Mapping[str, DataFrame], suites: Mapping[str, Sequence[Expectation]]
) -> DataFrame:
    return union_all([run_suite(tables[table], table, suite) for table, suite in suites.items()])


def suite_verdicts(results: DataFrame) -> DataFrame:
    """Pass or fail per suite with its failed expectations."""
    return results.groupBy("suite").agg(
        F.count(F.lit(1)).alias("expectations"),
        F.count_if(~F.col("passed")).alias("failed_expectations"),
        F.bool_and("passed").alias("suite_passed"),
    )
