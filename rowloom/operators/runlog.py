"""Analytics over a log of runs.

A run has ``run_id, run_type, status, created_at, duration_seconds, pinned, archived,
pack, scenario_id, config`` (JSON text), ``summary`` (a struct or map of results),
``stages`` (array of structs) and ``error_message``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions import fixed_values as fixed
from rowloom.functions.shapes import half_up
from rowloom.operators.indexing import dense_index
from rowloom.plans.joins import lookup

#: Newest runs that are kept, up to which their ids are broadcast.
BROADCAST_RUNS = 200_000


def run_metrics(runs: DataFrame, error_chars: int | None = None) -> DataFrame:
    """Long table ``(metric, label, value)``: counts by type and status, failures by the
    first line of their error (its first ``error_chars`` characters, if given), number of runs, total rows and mean
    duration. One pass: each run counts for all of its metrics at once.
    """
    rows = F.coalesce("summary.total_rows", "summary.total_rows_generated", "summary.rows_generated")
    error = F.substring_index(F.coalesce(F.col("error_message"), F.lit("unknown")), "\n", 1)
    if error_chars is not None:
        error = F.substring(error, 1, error_chars)
    # Runs of one kind are summed before they count for their metrics: few rows, whatever the log holds.
    seconds = F.col("duration_seconds").cast("decimal(28,6)")
    kinds = runs.groupBy(
        F.coalesce("run_type", F.lit("generate")).alias("type"), F.coalesce("status", F.lit("unknown")).alias("status"),
        F.when(F.col("status") == "failed", error).alias("failure"),
    ).agg(F.count(F.lit(1)).alias("runs"), F.sum(rows.cast("bigint")).alias("rows"), F.sum(seconds).alias("seconds"), F.count(seconds).alias("timed"))

    def entry(metric: str, label: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), label.alias("label"))

    entries = F.array(
        entry("runs_by_type", F.col("type")), entry("runs_by_status", F.col("status")),
        F.when(F.col("failure").isNotNull(), entry("failures", F.col("failure"))),
    )
    counted = kinds.select("runs", F.explode(entries).alias("e")).filter("e IS NOT NULL").groupBy("e.metric", "e.label").agg(
        F.sum("runs").cast("double").alias("value")
    )
    # One row of totals, also for a log without runs.
    mean = half_up(F.sum("seconds").cast("double") / F.nullif(F.sum("timed"), F.lit(0)), 2)
    sums = kinds.agg(
        *[c.cast("double").alias(m) for m, c in zip(TOTALS, (F.coalesce(F.sum("runs"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0)), mean), strict=True)]
    )
    totals = sums.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit("all").alias("label"), F.col(m).alias("value")) for m in TOTALS])).alias("e"))
    return counted.unionByName(totals.select("e.*"))


TOTALS = ("total_runs", "total_rows", "average_duration_seconds")


def run_timeline(runs: DataFrame) -> DataFrame:
    """Slowest finished stage of every run, with a hint when it took half the time or more."""
    timed = F.filter(
        "stages",
        lambda s: s["duration_seconds"].isNotNull() & (s["name"] != "") & s["status"].isin("completed", "failed"),
    )
    longest = F.array_max(F.transform("_timed", lambda s: s["duration_seconds"]))
    first = F.get(F.filter("_timed", lambda s: s["duration_seconds"] == F.col("_longest")), F.lit(0))
    share = F.floor(F.lit(100.0) * F.col("slowest_seconds") / F.col("duration_seconds") + 0.5).cast("int")
    slow = (F.col("duration_seconds") > 0) & (F.col("slowest_seconds") > 0)
    return (
        runs.withColumn("_timed", timed)
        .withColumn("_longest", longest)
        .withColumn("_slowest", F.when(F.col("_longest") > 0, first))
        .select(
            "run_id", "status", "run_type", "duration_seconds",
            F.size("_timed").alias("timed_stages"),
            F.col("_slowest.name").alias("slowest_stage"),
            F.col("_slowest.duration_seconds").alias("slowest_seconds"),
        )
        .withColumn("slowest_percent", F.when(slow, share))
        .withColumn(
            "why_slow_hint",
            F.when(
                F.col("slowest_percent") >= 50,
                F.concat(
                    F.col("slowest_stage"), F.lit(" took "), F.col("slowest_percent").cast("string"),
                    F.lit("% of total time"),
                ),
            ),
        )
    )


@dataclass(frozen=True)
class RetentionPolicy:
    keep_newest: int = 100
    max_age_days: float | None = None
    exclude_archived: bool = False
    exclude_statuses: Sequence[str] = ()
    exclude_run_types: Sequence[str] = ()


def retention_candidates(runs: DataFrame, policy: RetentionPolicy, now: Column) -> DataFrame:
    """Runs that may be removed: beyond the newest ``keep_newest``, or too old.

    Ranks count all runs, also those no policy may remove. Up to BROADCAST_RUNS the newest
    rows are gathered and broadcast; more are numbered by a range-partitioned sort.
    """
    order = [F.desc("created_at"), "run_id"]
    if policy.keep_newest <= BROADCAST_RUNS:
        newest = runs.orderBy(*order).limit(policy.keep_newest)
    else:
        newest = dense_index(runs.select("run_id", "created_at"), order, "_place").filter(F.col("_place") < policy.keep_newest)
    newest = newest.select("run_id", F.lit(True).alias("_newest"))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / F.lit(
        86_400_000_000.0
    )
    kept = F.coalesce("_newest", F.lit(False))
    removable = ~F.col("pinned")
    if policy.exclude_archived:
        removable = removable & ~F.col("archived")
    if policy.exclude_statuses:
        removable = removable & ~F.coalesce("status", F.lit("")).isin(list(policy.exclude_statuses))
    if policy.exclude_run_types:
        removable = removable & ~F.coalesce("run_type", F.lit("")).isin(list(policy.exclude_run_types))
    too_old = F.lit(False)
    if policy.max_age_days:
        too_old = F.col("age_days") > F.lit(float(policy.max_age_days))
    return (
        runs.join(F.broadcast(newest) if policy.keep_newest <= BROADCAST_RUNS else newest, "run_id", "left")
        .withColumn("age_days", age)
        .filter(removable & (~kept | too_old))
        .select("run_id", "run_type", "status", "created_at", "age_days")
    )


def search_runs(
    runs: DataFrame, filters: Mapping[str, str], config_filters: Mapping[str, str] | None = None,
    include_archived: bool = True, limit: int = 100, offset: int = 0, before: tuple[object, object] | None = None,
) -> DataFrame:
    """A page of runs, newest first. ``before`` is the ``(created_at, run_id)`` of the
    last row of the previous page and replaces ``offset``."""
    found = runs
    for name, value in filters.items():
        found = found.filter(F.col(name) == value)
    for name, value in (config_filters or {}).items():
        found = found.filter(F.get_json_object("config", f"$.{name}") == value)
    if not include_archived:
        found = found.filter(~F.col("archived"))
    return page(found, "created_at", "run_id", limit, offset, before)


def page(
    df: DataFrame, time: str, key: str, limit: int, offset: int = 0, before: tuple[object, object] | None = None
) -> DataFrame:
    """One page, newest first with the key as tie-break."""
    if before is not None:
        at, after = F.lit(before[0]), F.lit(before[1])
        df = df.filter((F.col(time) < at) | ((F.col(time) == at) & (F.col(key) > after)))
        offset = 0
    ordered = df.orderBy(F.desc(time), key)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def search_text(
    df: DataFrame, needle: str | None = None, text_columns: Sequence[str] = (), category: tuple[str, str] | None = None,
    tag: tuple[str, str] | None = None,
) -> DataFrame:
    """Rows of a category that carry a tag and hold the needle in any of the texts, whatever the case."""
    if category is not None:
        df = df.filter(F.col(category[0]) == category[1])
    if tag is not None:
        df = df.filter(F.array_contains(tag[0], tag[1]))
    if needle:
        hit = F.lit(False)
        for name in text_columns:
            hit = hit | F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit(needle.lower()))
        df = df.filter(hit)
    return df


def mask_secrets(config: str) -> Column:
    """JSON text in which string values under secret-looking keys are masked, at any depth.

    Works on the text itself, so the rest of the document stays as it was. Escaped backslashes and quotes are
    set aside as two characters no text should hold (one that does gets them as JSON escapes), so that a string is
    just what stands between two quotes and its length doesn't matter. Only strings are masked.
    """
    slash, quote = "\ufdd0", "\ufdd1"
    key = "|".join(fixed.SECRET_KEY_PARTS)
    pattern = rf'("(?=[^"]*(?i:{key}))[^"]*+"\s*:\s*)"(?!")[^"]*+"'
    text = F.replace(F.replace(F.col(config), F.lit(slash), F.lit("\\ufdd0")), F.lit(quote), F.lit("\\ufdd1"))
    text = F.replace(F.replace(text, F.lit("\\\\"), F.lit(slash)), F.lit('\\"'), F.lit(quote))
    masked = F.regexp_replace(text, pattern, f'$1"{fixed.SECRET_MASK}"')
    return F.replace(F.replace(masked, F.lit(quote), F.lit('\\"')), F.lit(slash), F.lit("\\\\"))


def run_lineage(runs: DataFrame, scenarios: DataFrame, schemas: DataFrame) -> DataFrame:
    """Where each run came from: scenario, its version, pack or custom schema.

    Scenario and schema keys are unique, so each lookup keeps one row per run, also
    where one scenario is behind a third of the runs.
    """
    wanted = runs.withColumns(
        {
            "custom_schema_id": F.get_json_object("config", "$.custom_schema_id"),
            "_pack": F.coalesce(F.col("pack"), F.get_json_object("config", "$.pack")),
        }
    ).select("run_id", "run_type", "scenario_id", "custom_schema_id", "_pack")
    named = scenarios.select(
        "scenario_id", F.col("name").alias("scenario_name"), F.col("version").alias("scenario_version")
    )
    known = schemas.select(F.col("schema_id").alias("custom_schema_id"), F.lit(True).alias("_found"))
    return (
        lookup(lookup(wanted, named, ["scenario_id"]), known, ["custom_schema_id"])
        .select(
            "run_id", "run_type", "scenario_id", "scenario_name", "scenario_version",
            F.col("_pack").alias("pack"),
            "custom_schema_id",
            F.when(F.col("custom_schema_id").isNotNull(), "custom_schema").otherwise("pack").alias("schema_source"),
            (F.col("custom_schema_id").isNotNull() & F.col("_found").isNull()).alias("schema_missing"),
        )
    )
