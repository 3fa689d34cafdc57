"""Business rules as boolean columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.operators.integrity import orphan_values
from rowloom.operators.keys import duplicate_totals
from rowloom.plans.catalog import union_all
from rowloom.plans.spec import BusinessRule

ROW_RULES = ("order", "range", "equality", "enum", "pattern", "custom")
SAMPLES_PER_RULE = 10
SAMPLES_TOTAL = 50
SUM_TOLERANCE = 1e-6


def violated(rule: BusinessRule, df: DataFrame | None = None) -> Column:
    """True where a row breaks the rule, false where it holds or can't be judged.

    With the table given, text is compared to numbers and times by what it parses to; text that doesn't parse can't
    be judged.
    """
    if rule.kind == "order":
        broken = ~_ordered(rule.expression, df)
    elif rule.kind == "range":
        broken = _outside(rule, df)
    elif rule.kind == "equality":
        left, right = rule.expression.split("==", 1)
        broken = ~F.expr(left).eqNullSafe(F.expr(right))
    elif rule.kind == "enum":
        broken = F.lit(False)
        for name in rule.fields:
            broken = broken | F.coalesce(~F.col(name).isin(list(rule.params["values"])), F.lit(False))
    elif rule.kind == "pattern":
        broken = F.lit(False)
        for name in rule.fields:
            broken = broken | F.coalesce(~F.col(name).rlike(rule.params["pattern"]), F.lit(False))
    elif rule.kind == "custom":
        check = rule.params.get("callback")
        broken = ~(check() if check else F.expr(rule.expression))
    else:
        raise ValueError(f"{rule.name}: {rule.kind} is not a row rule")
    return F.coalesce(broken, F.lit(False))


ORDER_SIGN = re.compile(r"(<=|>=|<(?![=>])|(?<![<])>(?!=))")


def _ordered(expression: str, df: DataFrame | None) -> Column:
    sides = ORDER_SIGN.split(expression)
    if df is None or len(sides) != 3:
        return F.expr(expression)
    left, sign, right = F.expr(sides[0]), sides[1], F.expr(sides[2])
    kinds = [f.dataType for f in df.select(left.alias("l"), right.alias("r")).schema.fields]
    text = [isinstance(k, T.StringType) for k in kinds]
    if text[0] and not text[1]:
        left = left.try_cast("double" if isinstance(kinds[1], T.NumericType) else kinds[1])
    elif text[1] and not text[0]:
        right = right.try_cast("double" if isinstance(kinds[0], T.NumericType) else kinds[0])
    elif all(text):
        # Two texts are numbers if both parse, else plain text.
        numbers = [side.try_cast("double") for side in (left, right)]
        both = numbers[0].isNotNull() & numbers[1].isNotNull()
        return F.when(both, _compared(numbers[0], sign, numbers[1])).otherwise(_compared(left, sign, right))
    elif isinstance(kinds[0], T.NumericType) != isinstance(kinds[1], T.NumericType):
        return F.lit(True)
    return _compared(left, sign, right)


def _compared(left: Column, sign: str, right: Column) -> Column:
    return {"<=": left <= right, ">=": left >= right, "<": left < right, ">": left > right}[sign]


def _outside(rule: BusinessRule, df: DataFrame | None) -> Column:
    kinds = dict(df.dtypes) if df is not None else {}
    broken = F.lit(False)
    for name in rule.fields:
        for bound, sign in (("min", "<"), ("max", ">")):
            limit = rule.params.get(bound)
            if limit is None:
                continue
            value = F.col(name)
            if kinds.get(name) == "string" and not isinstance(limit, str):
                value = value.try_cast("double")
            broken = broken | F.coalesce(_compared(value, sign, F.lit(limit)), F.lit(False))
    return broken


def row_violations(df: DataFrame, table: str, rules: Sequence[BusinessRule]) -> DataFrame:
    """Violations of all row rules of a table in a single aggregation pass."""
    own = [r for r in rules if r.table == table and r.kind in ROW_RULES]
    totals = df.agg(*[F.count_if(violated(r, df)).alias(f"v_{i}") for i, r in enumerate(own)])
    entries = [
        F.struct(F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), F.col(f"v_{i}").alias("violations"))
        for i, r in enumerate(own)
    ]
    return totals.select(F.explode(F.array(*entries)).alias("e")).select(
        F.lit(table).alias("table_name"), "e.rule", "e.kind", "e.violations"
    )


def sum_violations(parent: DataFrame, child: DataFrame, rule: BusinessRule) -> DataFrame:
    """Parents whose total differs from the sum of their children.

    Children are summed per parent before the join; money is summed as decimals so
    that the result does not depend on the order of addition. A NaN among the children or as the total
    can't be judged; an infinite child never equals a finite total.
    """
    p = rule.params
    tolerance = F.lit(p.get("tolerance", SUM_TOLERANCE))
    amount = F.col(p["child_field"]).try_cast("double")
    finite = ~F.isnan(amount) & (F.abs(amount) < float("inf"))
    sums = child.groupBy(F.col(p["child_key"]).alias("_key")).agg(
        F.sum(F.when(finite, F.col(p["child_field"]).try_cast("decimal(28,6)"))).alias("_sum"),
        F.sum(F.when(~finite, amount)).alias("_odd"),
    )
    total = F.col(p["total_field"])
    summed = F.coalesce(F.col("_sum"), F.lit(0)).cast("double") + F.coalesce("_odd", F.lit(0.0))
    return (
        parent.filter(total.isNotNull())
        .join(sums, F.col(p["parent_key"]) == F.col("_key"), "left")
        .filter(~F.isnan(summed) & ~F.isnan(total.cast("double")) & (F.abs(total - summed) > tolerance))
        .withColumn("children_sum", summed)
        .drop("_key", "_sum", "_odd")
    )


def rule_violations(tables: Mapping[str, DataFrame], rules: Sequence[BusinessRule]) -> DataFrame:
    """Violations per rule for rules of every kind."""
    parts = []
    for table in dict.fromkeys(r.table for r in rules):
        if any(r.table == table and r.kind in ROW_RULES for r in rules):
            parts.append(row_violations(tables[table], table, rules))
    for rule in rules:
        if rule.kind == "sum":
            broken = sum_violations(tables[rule.table], tables[rule.params["child_table"]], rule)
            counted = broken.agg(F.count(F.lit(1)).alias("violations"))
        elif rule.kind == "uniqueness":
            counted = duplicate_totals(tables[rule.table], rule.table, rule.fields, ignore_null=True).select(
                F.col("duplicate_rows").alias("violations")
            )
        elif rule.kind == "reference":
            orphans = orphan_values(
                tables[rule.table], rule.fields, tables[rule.params["parent"]], rule.params["parent_columns"]
            )
            counted = orphans.agg(F.coalesce(F.sum("child_rows"), F.lit(0)).alias("violations"))
        else:
            continue
        parts.append(
            counted.select(
                F.lit(rule.table).alias("table_name"), F.lit(rule.name).alias("rule"),
                F.lit(rule.kind).alias("kind"), "violations",
            )
        )
    return union_all(parts)


def violation_samples(
    df: DataFrame, table: str, rules: Sequence[BusinessRule], order: str,
    per_rule: int = SAMPLES_PER_RULE, total: int = SAMPLES_TOTAL,
) -> DataFrame:
    """The first rows that break each rule, at most ``per_rule`` each and ``total`` together.

    The rank limit is applied inside every task before the shuffle, so each rule's
    group stays small however many rows break it.
    """
    own = [r for r in rules if r.table == table and r.kind in ROW_RULES]
    names = F.array(*[F.when(violated(r, df), F.lit(r.name)) for r in own])
    broken = df.withColumn("rule", F.explode(names)).filter(F.col("rule").isNotNull())
    rank = F.row_number().over(Window.partitionBy("rule").orderBy(order))
    return (
        broken.withColumn("sample_no", rank)
        .filter(F.col("sample_no") <= per_rule)
        .orderBy(order, "rule")
        .limit(total)
        .withColumn("table_name", F.lit(table))
    )
