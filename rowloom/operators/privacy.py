"""PII classification, masking, risk score and policy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions import fixed_values as fixed

UNCLASSIFIED = "unclassified"


class PolicyBlocked(Exception):
    """Raised by ``enforce`` when the policy decides to block."""


@dataclass(frozen=True)
class Policy:
    mode: str = "advisory"
    privacy_mode: str = "off"
    max_risk_score: int | None = None
    max_sensitive_columns: int | None = None
    fail_on_high_risk: bool = False
    block_categories: Sequence[str] = ()


def _normal(name: Column) -> Column:
    return F.translate(F.lower(name), "- ", "__")


def _first_line(name: Column) -> Column:
    """Number of the first pattern line with a name that occurs in the column's name."""
    lines = fixed.NAME_PATTERNS
    return F.coalesce(*[F.when(name.rlike("|".join(names)), F.lit(i)) for i, (_, _, names) in enumerate(lines)])


def classify(
    catalog: DataFrame, overrides: Mapping[tuple[str, str], str] | None = None, hint: str | None = None
) -> DataFrame:
    """Add ``category`` and ``certainty`` to a column catalog.

    An override decides first, then a generator hint, then the column's name.
    """
    forced, hinted = F.lit(None).cast("string"), F.lit(None).cast("string")
    if overrides:
        pairs = [F.lit(x) for (table, column), meant in overrides.items() for x in (f"{table}.{column}", meant)]
        forced = F.try_element_at(F.create_map(*pairs), F.concat_ws(".", "table_name", "column_name"))
    if hint is not None:
        pairs = [F.lit(x) for pair in fixed.HINT_CATEGORIES.items() for x in pair]
        hinted = F.try_element_at(F.create_map(*pairs), _normal(F.col(hint)))
    categories = F.array(*[F.lit(category) for category, _, _ in fixed.NAME_PATTERNS])
    certainties = F.array(*[F.lit(certainty) for _, certainty, _ in fixed.NAME_PATTERNS])
    # Staged, so that the pattern lines are searched once per column.
    staged = catalog.withColumns(
        {"_forced": forced, "_hinted": hinted, "_line": _first_line(_normal(F.col("column_name")))}
    )
    settled = F.coalesce("_forced", "_hinted")
    return staged.withColumns(
        {
            "category": F.coalesce(settled, F.get(categories, F.col("_line")), F.lit(UNCLASSIFIED)),
            "certainty": F.when(settled.isNotNull(), "detected").otherwise(
                F.coalesce(F.get(certainties, F.col("_line")), F.lit(UNCLASSIFIED))
            ),
            "decided_by": F.when(F.col("_forced").isNotNull(), "override")
            .when(F.col("_hinted").isNotNull(), "hint")
            .when(F.col("_line").isNotNull(), "pattern")
            .otherwise("none"),
        }
    ).drop("_forced", "_hinted", "_line")


def warnings(classified: DataFrame) -> DataFrame:
    """Messages for suspected fields, credentials and financial fields found by name."""
    field = F.concat(F.lit(" field: "), F.col("table_name"), F.lit("."), F.col("column_name"))
    message = F.when(
        F.col("certainty") == "suspected", F.concat(F.lit("Detected suspected "), F.col("category"), field)
    ).when(F.col("category").isin("credentials", "financial"), F.concat(F.lit("Detected "), F.col("category"), field))
    return (
        classified.filter(F.col("decided_by") == "pattern")
        .withColumn("warning", message)
        .filter(F.col("warning").isNotNull())
    )


def mask_for(category: str, masks: Mapping[str, str] | None = None) -> str:
    return {**fixed.CATEGORY_MASKS, **(masks or {})}.get(category, fixed.DEFAULT_MASK)


def redact(df: DataFrame, categories: Mapping[str, str], masks: Mapping[str, str] | None = None) -> DataFrame:
    """Replace filled cells of sensitive columns by their category's mask."""
    columns = []
    for name in df.columns:
        category = categories.get(name, UNCLASSIFIED)
        if category == UNCLASSIFIED:
            columns.append(F.col(name))
        else:
            masked = F.when(F.col(name).isNotNull(), F.lit(mask_for(category, masks)))
            columns.append(masked.alias(name))
    return df.select(*columns)


def category_summary(classified: DataFrame) -> DataFrame:
    """Sensitive columns per category and whether the category is high risk."""
    return (
        classified.filter(F.col("category") != UNCLASSIFIED)
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("sensitive_columns"))
        .withColumn("high_risk", F.col("category").isin(*fixed.HIGH_RISK))
    )


def scorecard(summary: DataFrame) -> DataFrame:
    """Weighted points of all categories, capped at one hundred."""
    weight = F.lit(1)
    for category, value in fixed.RISK_WEIGHTS.items():
        weight = F.when(F.col("category") == category, F.lit(value)).otherwise(weight)
    score = F.least(F.lit(100), F.col("points") * fixed.POINTS_PER_WEIGHT)
    return (
        summary.agg(
            F.coalesce(F.sum(weight * F.col("sensitive_columns")), F.lit(0)).alias("points"),
            F.count(F.lit(1)).alias("sensitive_categories"),
            F.coalesce(F.sum("sensitive_columns"), F.lit(0)).alias("sensitive_columns"),
            F.array_sort(F.collect_set("category")).alias("categories"),
        )
        .withColumn("risk_score", score)
        .withColumn(
            "risk_level",
            F.when(F.col("risk_score") >= fixed.HIGH_SCORE, "high")
            .when(F.col("risk_score") >= fixed.MEDIUM_SCORE, "medium")
            .otherwise("low"),
        )
        .withColumn(
            "high_risk_categories",
            F.concat_ws(",", F.array_intersect(F.array(*[F.lit(c) for c in fixed.HIGH_RISK]), "categories")),
        )
        .drop("points")
    )


def decide(score: DataFrame, *policies: Policy) -> DataFrame:
    """Violations of each policy and its decision: allow, warn or block."""
    staged = score.select(
        "risk_score", "risk_level", "sensitive_columns",
        F.explode(F.array(*[_judge(p) for p in policies])).alias("_judged"),
    )
    count = F.size("_judged.violations")
    return staged.select(
        "risk_score", "risk_level", "sensitive_columns",
        count.alias("violation_count"),
        F.concat_ws(";", "_judged.violations").alias("violations"),
        F.col("_judged.policy_mode").alias("policy_mode"),
        F.when((count > 0) & (F.col("_judged.policy_mode") == "enforce"), "block")
        .when(count > 0, "warn")
        .otherwise("allow")
        .alias("policy_decision"),
    )


def _judge(policy: Policy) -> Column:
    checks = []
    if policy.max_risk_score is not None:
        checks.append(_over("risk_score_exceeds_threshold", "risk_score", policy.max_risk_score))
    if policy.max_sensitive_columns is not None:
        checks.append(_over("sensitive_columns_exceed_threshold", "sensitive_columns", policy.max_sensitive_columns))
    if policy.fail_on_high_risk and policy.privacy_mode == "strict":
        checks.append(
            F.when(
                F.col("high_risk_categories") != "",
                F.concat(F.lit("high_risk_categories_present:"), F.col("high_risk_categories")),
            )
        )
    for category in sorted(set(policy.block_categories)):
        checks.append(
            F.when(F.array_contains("categories", category), F.lit(f"blocked_category_detected:{category}"))
        )
    mode = policy.mode if policy.mode in ("advisory", "enforce") else "advisory"
    violations = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    return F.struct(violations.alias("violations"), F.lit(mode).alias("policy_mode"))


def _over(code: str, column: str, limit: int) -> Column:
    return F.when(
        F.col(column) > limit, F.concat(F.lit(code + ":"), F.col(column).cast("string"), F.lit(f">{limit}"))
    )


def enforce(decision: DataFrame) -> None:
    """Stop the job when the one-row decision says so."""
    row = decision.first()
    if row["policy_decision"] == "block":
        raise PolicyBlocked(row["violations"])


def redaction_audit(samples: DataFrame, classified: DataFrame) -> DataFrame:
    """Masked cells per table: samples shown times the table's sensitive columns."""
    per_table = (
        classified.filter(F.col("category") != UNCLASSIFIED)
        .groupBy("table_name")
        .agg(F.count(F.lit(1)).alias("sensitive_columns"))
    )
    shown = samples.groupBy("table_name").agg(F.count(F.lit(1)).alias("samples"))
    return shown.join(per_table, "table_name", "left").select(
        "table_name",
        "samples",
        F.coalesce("sensitive_columns", F.lit(0)).alias("sensitive_columns"),
        (F.col("samples") * F.coalesce("sensitive_columns", F.lit(0))).alias("redactions_applied"),
    )
