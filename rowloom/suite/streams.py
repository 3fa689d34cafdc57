"""Streams over the given tables; each has the batch result as its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import rng
from rowloom.operators import change_tags, events, privacy, rules
from rowloom.operators.selection import share_of_rows
from rowloom.streaming import operators as streaming
from rowloom.streaming.runner import BATCH, event_time, run_available, run_batches, run_observed, run_updates, stream_table
from rowloom.suite import duck
from rowloom.suite.degradation import SEED, cdc_sql, incremental_sql
from rowloom.suite.eventing import LATE_SQL, REASON, SESSION_GAP, SESSIONS, WINDOWS, checked_records
from rowloom.suite.quality import BROKEN, CUSTOMER_CATEGORIES, LINE_RULES, SETTLED, SOLVENT
from rowloom.suite.registry import query, table


@query("stream_tag_cdc", cdc_sql(f"{duck.uniform(SEED, 'orders.change', 'o_orderkey')} < 0.2"))
def stream_tag_cdc(spark: SparkSession, folder: str) -> DataFrame:
    orders = stream_table(spark, folder, "orders")
    changed = share_of_rows(0.2, SEED, "orders.change", "o_orderkey")
    return run_available(change_tags.tag_cdc(orders, "o_orderkey", changed, SEED, "orders", "b7"), "cdc")


@query(
    "stream_redact",
    """SELECT c_custkey, '***REDACTED***' AS c_name, c_nationkey, '***@***' AS c_acctbal, '***SECRET***' AS c_mktsegment
    FROM customer""",
)
def stream_redact(spark: SparkSession, folder: str) -> DataFrame:
    return run_available(privacy.redact(stream_table(spark, folder, "customer"), CUSTOMER_CATEGORIES), "redact")


@query(
    "stream_rule_violations",
    " UNION ALL ".join(
        f"SELECT l_orderkey, l_linenumber, l_extendedprice, '{r.name}' AS rule FROM lineitem WHERE {BROKEN[r.name]}"
        for r in LINE_RULES
    ),
)
def stream_rule_violations(spark: SparkSession, folder: str) -> DataFrame:
    lines = stream_table(spark, folder, "lineitem")
    broken = F.explode(F.array(*[F.when(rules.violated(r), F.lit(r.name)) for r in LINE_RULES]))
    found = lines.select("l_orderkey", "l_linenumber", "l_extendedprice", broken.alias("rule")).filter("rule IS NOT NULL")
    return run_available(found, "rules")


@query("stream_late_arrivals", LATE_SQL)
def stream_late_arrivals(spark: SparkSession, folder: str) -> DataFrame:
    return run_available(events.late_arrivals(stream_table(spark, folder, "events"), "event_id", 0.15, SEED), "late")


@query("stream_json_contract", f"SELECT event_id, {REASON} IS NULL AS passed, {REASON} AS reason FROM events")
def stream_json_contract(spark: SparkSession, folder: str) -> DataFrame:
    return run_available(checked_records(stream_table(spark, folder, "events")), "contract")


@query(
    "stream_ref_orphans",
    f"SELECT * FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM {SOLVENT})",
)
def stream_ref_orphans(spark: SparkSession, folder: str) -> DataFrame:
    solvent = table(spark, folder, "customer").filter("c_acctbal > 0")
    orders = stream_table(spark, folder, "orders")
    return run_available(streaming.stream_orphans(orders, "o_custkey", solvent, "c_custkey"), "orphans")


@query(
    "stream_event_windows",
    f"SELECT * FROM ({WINDOWS}) WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
)
def stream_event_windows(spark: SparkSession, folder: str) -> DataFrame:
    arriving = event_time(stream_table(spark, folder, "events"), "ts")
    return run_available(streaming.closed_windows(arriving, "1 day", "1 hour", ["event_type"], "value"), "windows")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    arriving = event_time(stream_table(spark, folder, "events"), "ts")
    kept = streaming.keep_first_in_watermark(arriving, ["user_id", "event_type"], "ts", "60 days")
    return run_available(kept.select("user_id", "event_type"), "dedup")


@query(
    "stream_cdc_op_check",
    """SELECT event_id, event_type AS op_type FROM events WHERE event_type NOT IN ('view', 'click')""",
)
def stream_cdc_op_check(spark: SparkSession, folder: str) -> DataFrame:
    op = F.expr("CASE event_type WHEN 'view' THEN 'INSERT' WHEN 'click' THEN 'DELETE' ELSE event_type END")
    tagged = stream_table(spark, folder, "events").select("event_id", op.alias("op_type"))
    return run_available(tagged.filter(change_tags.invalid_operation("op_type")), "ops")


@query(
    "stream_linked_notes",
    f"""SELECT 'note ' || event_id AS note, event_id, event_type, value FROM events WHERE
    {duck.uniform(SEED, 'stream.note', 'event_id')} < 0.3::DOUBLE""",
)
def stream_linked_notes(spark: SparkSession, folder: str) -> DataFrame:
    arriving = event_time(stream_table(spark, folder, "events"), "ts").select("event_id", "ts", "event_type", "value")
    notes = (
        event_time(stream_table(spark, folder, "events"), "ts")
        .filter(rng.below(0.3, SEED, "stream.note", "event_id"))
        .select(
            F.col("event_id").alias("linked_event_id"),
            (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("note_ts"),
            F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("note"),
        )
    )
    joined = streaming.linked_notes(arriving, notes, "1 hour", "1 HOUR")
    return run_available(joined.select("note", "event_id", "event_type", "value"), "notes")


CHANGED_SHARE = f"{duck.uniform(SEED, 'orders.change', 'o_orderkey')} < 0.2"


@query("stream_tag_incremental", incremental_sql(CHANGED_SHARE))
def stream_tag_incremental(spark: SparkSession, folder: str) -> DataFrame:
    orders = stream_table(spark, folder, "orders")
    changed = share_of_rows(0.2, SEED, "orders.change", "o_orderkey")
    return run_available(change_tags.tag_incremental(orders, "o_orderkey", changed, SEED), "incremental")


@query(
    "stream_rule_counts",
    " UNION ALL ".join(
        f"SELECT 'lineitem' AS table_name, '{r.name}' AS rule, '{r.kind}' AS kind, count(*) FILTER ({BROKEN[r.name]}) AS violations FROM lineitem"
        for r in LINE_RULES
    ),
)
def stream_rule_counts(spark: SparkSession, folder: str) -> DataFrame:
    lines = stream_table(spark, folder, "lineitem")
    return run_updates(streaming.rule_counts(lines, "lineitem", LINE_RULES), ["table_name", "rule", "kind"], "rule-counts")


@query(
    "stream_event_sessions",
    f"SELECT * FROM ({SESSIONS}) WHERE session_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
)
def stream_event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    arriving = event_time(stream_table(spark, folder, "events"), "ts")
    return run_available(streaming.closed_sessions(arriving, SESSION_GAP, "1 hour", ["user_id"], "value"), "sessions")


# The latest event of each kind and user, of those that were quiet for the last day

@query(
    "stream_silver_dedup",
    """SELECT event_id, user_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1
    AND max(ts) OVER (PARTITION BY user_id, event_type) < (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
)
def stream_silver_dedup(spark: SparkSession, folder: str) -> DataFrame:
    arriving = event_time(stream_table(spark, folder, "events"), "ts").withColumn("newest_first", -F.col("event_id"))
    kept = streaming.keep_least_in_watermark(arriving, ["user_id", "event_type"], "newest_first", "ts", "1 day")
    return run_available(kept.select("event_id", "user_id", "event_type", "value"), "first")


# A third of the notes name an event that isn't there; those of the last hours may still get theirs

STRAY = f"{duck.uniform(SEED, 'stream.stray', 'event_id')} < 0.33::DOUBLE"
NOTE = f"{duck.uniform(SEED, 'stream.note', 'event_id')} < 0.3::DOUBLE"


@query(
    "stream_link_orphans",
    f"""WITH n AS (SELECT 'note ' || event_id AS note, -event_id AS linked_event_id, ts + INTERVAL 10 MINUTE AS note_ts, {STRAY} AS stray
      FROM events WHERE {NOTE})
    SELECT note, linked_event_id FROM n WHERE stray AND linked_event_id < 0
    AND note_ts < least((SELECT max(ts) FROM events), (SELECT max(note_ts) FROM n)) - INTERVAL 1 HOUR""",
)
def stream_link_orphans(spark: SparkSession, folder: str) -> DataFrame:
    arriving = event_time(stream_table(spark, folder, "events"), "ts").select("event_id", "ts", "event_type", "value")
    lost = rng.below(0.33, SEED, "stream.stray", "event_id")
    notes = (
        event_time(stream_table(spark, folder, "events"), "ts")
        .filter(rng.below(0.3, SEED, "stream.note", "event_id"))
        .select(
            F.when(lost, -F.col("event_id")).otherwise(F.col("event_id")).alias("linked_event_id"),
            (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("note_ts"),
            F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("note"),
        )
    )
    return run_available(streaming.unlinked_notes(arriving, notes, "1 hour", "1 HOUR").select("note", "linked_event_id"), "stray")


@query("stream_ref_orphans_split", f"SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM {SETTLED})")
def stream_ref_orphans_split(spark: SparkSession, folder: str) -> DataFrame:
    settled = table(spark, folder, "orders").filter("o_orderstatus <> 'P'")
    lines = stream_table(spark, folder, "lineitem")
    return run_batches(lines, streaming.split_orphans(lines, "l_orderkey", settled, "o_orderkey"), "split").drop(BATCH)


@query(
    "stream_late_metrics",
    f"""SELECT count(*) AS events, count(*) FILTER (late_arrival) AS late_events,
    count(*) FILTER (late_arrival AND ts - event_ts_original > INTERVAL 30 MINUTE) AS beyond_allowed, 0::BIGINT AS late_dropped FROM ({LATE_SQL})""",
)
def stream_late_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """What was measured while the windowed totals of late events ran."""
    late = events.late_arrivals(stream_table(spark, folder, "events"), "event_id", 0.15, SEED)
    measured = event_time(streaming.observed_late(late, "30 MINUTES"), "ts")
    windows = streaming.closed_windows(measured, "1 hour", "2 hours", ["event_type"], "value")
    _, batches = run_observed(windows, "late-metrics")
    names = ("events", "late_events", "beyond_allowed", "late_dropped")
    rows = spark.createDataFrame([tuple(b.get(n) or 0 for n in names) for b in batches], ", ".join(f"{n} bigint" for n in names))
    return rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
