"""All row checks of a table in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.operators.change_tags import invalid_operation
from rowloom.operators.expectations import UNIQUE, Expectation, failing_rows
from rowloom.operators.rules import ROW_RULES, violated
from rowloom.plans.catalog import union_all
from rowloom.plans.spec import BusinessRule


def table_report(
    df: DataFrame, table: str, rules: Sequence[BusinessRule] = (), suite: Sequence[Expectation] = (), operation: str | None = None
) -> DataFrame:
    """``table_name, check, subject, failing, total_rows``: null cells per column, rules, expectations, change operations.

    Everything is one aggregation, so the table is read once. Uniqueness, sums and references need groups or joins
    of their own and aren't row checks.
    """
    checks = [("nulls", c, F.count(F.lit(1)) - F.count(F.col(f"`{c}`"))) for c in df.columns]
    checks += [("rule", r.name, F.count_if(violated(r, df))) for r in rules if r.table == table and r.kind in ROW_RULES]
    checks += [(e.kind, e.column or "", failing_rows(df, e)) for e in suite if e.kind != UNIQUE]
    if operation is not None:
        checks.append(("operation", operation, F.count_if(invalid_operation(operation))))
    totals = df.agg(F.count(F.lit(1)).alias("total_rows"), *[value.cast("bigint").alias(f"c_{i}") for i, (_, _, value) in enumerate(checks)])
    entries = [
        F.struct(F.lit(kind).alias("check"), F.lit(subject).alias("subject"), F.col(f"c_{i}").alias("failing"))
        for i, (kind, subject, _) in enumerate(checks)
    ]
    return totals.select("total_rows", F.explode(F.array(*entries)).alias("e")).select(
        F.lit(table).alias("table_name"), "e.check", "e.subject", "e.failing", "total_rows"
    )


def quality_report(
    tables: Mapping[str, DataFrame], rules: Sequence[BusinessRule] = (), suites: Mapping[str, Sequence[Expectation]] | None = None
) -> DataFrame:
    """The row checks of several tables; each table is read once."""
    return union_all([table_report(df, name, rules, (suites or {}).get(name, ())) for name, df in tables.items()])
