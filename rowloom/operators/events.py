"""Event streams, late arrivals, replay order, linked notes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions import fixed_values as fixed
from rowloom.functions import rng
from rowloom.functions.shapes import half_up
from rowloom.functions.time_patterns import RISING, at_offset, offset_micros
from rowloom.operators.indexing import dense_index

LATE_SECONDS = (60, 3600)
REPLAY_CHUNKS = 5


def event_times(
    df: DataFrame, position: str, count: int, pattern: str, start: str, span_micros: int, seed: int
) -> DataFrame:
    """Add ``ts`` to rows that hold event positions ``0 .. count-1``."""
    offset = offset_micros(pattern, position, count, span_micros, seed)
    return df.withColumn("_offset", offset).withColumn("ts", at_offset(start, F.col("_offset"))).drop("_offset")


def generate_events(
    df: DataFrame, position: str, count: int, domain: str, pattern: str, start: str, span_micros: int, seed: int
) -> DataFrame:
    """Events ``(event_no, event_id, ts, event_type, entity_id)`` numbered in time order.

    Growth times rise with the position and need no sort. Other patterns are sorted
    by range partitions and numbered without a single-task window.
    """
    types = fixed.EVENT_TYPES.get(domain, ["event"])
    timed = event_times(df.select(F.col(position).alias("_at")), "_at", count, pattern, start, span_micros, seed)
    if pattern in RISING:
        numbered = timed.withColumnRenamed("_at", "event_no")
    else:
        numbered = dense_index(timed, ["ts", "_at"], "event_no")
    number = F.col("event_no")
    entity = rng.randint(seed, "event.entity", "event_no", 1, max(1, count // 10))
    return numbered.select(
        number,
        F.concat(F.lit("evt_"), F.lpad(number.cast("string"), 8, "0")).alias("event_id"),
        "ts",
        rng.choose(seed, "event.type", "event_no", types).alias("event_type"),
        F.concat(F.lit("entity_"), entity.cast("string")).alias("entity_id"),
    )


def late_arrivals(df: DataFrame, key: str, ratio: float, seed: int, time: str = "ts") -> DataFrame:
    """Delay a share of the events by one minute to one hour, to the millisecond.

    ``late_arrival`` and ``event_ts_original`` exist for all events; the original time
    is null where nothing was delayed.
    """
    low, high = (s * 1000 for s in LATE_SECONDS)
    delay = rng.randint(seed, "late.delay", key, low, high)
    late = df.withColumn("late_arrival", rng.below(ratio, seed, "late.pick", key))
    shifted = F.col(time) + F.make_dt_interval(secs=(delay / F.lit(1000).cast("decimal(10,0)")).cast("decimal(12,6)"))
    return late.withColumn("event_ts_original", F.when(F.col("late_arrival"), F.col(time))).withColumn(
        time, F.when(F.col("late_arrival"), shifted).otherwise(F.col(time))
    )


def replay_order(df: DataFrame, position: str, count: int, mode: str, seed: int) -> DataFrame:
    """Add ``arrival_seq``: as is, shuffled as a whole, or shuffled inside consecutive chunks."""
    if mode == "ordered":
        return df.withColumn("arrival_seq", F.col(position))
    spread = rng.draw(seed, f"replay.{mode}", position)
    order: list[Column | str] = [spread, F.col(position)]
    if mode == "windowed":
        width = max(1, count // REPLAY_CHUNKS)
        order = [F.floor(F.col(position) / F.lit(width)), *order]
    return dense_index(df, order, "arrival_seq")


def support_notes(events: DataFrame, position: str, chosen: Column, seed: int) -> DataFrame:
    """A text note for every chosen event, linked by the event id.

    Ticket numbers follow the event position, so no ranking is needed to number them.
    """
    at = F.col(position)
    text = rng.choose(seed, "note.template", position, fixed.NOTE_TEMPLATES)
    note = F.replace(F.replace(text, F.lit("{event_type}"), F.col("event_type")), F.lit("{entity_id}"), F.col("entity_id"))
    return events.filter(chosen).select(
        F.concat(F.lit("ticket_"), F.lpad(at.cast("string"), 7, "0")).alias("ticket_id"),
        "entity_id",
        F.col("event_id").alias("linked_event_id"),
        "event_type",
        "ts",
        note.alias("note"),
        rng.choose(seed, "note.severity", position, fixed.SEVERITIES).alias("severity"),
    )


def link_totals(events: DataFrame, notes: DataFrame) -> DataFrame:
    """One row: events, notes, matched and orphan links, coverage.

    Ids of events and links of notes are counted together, one shuffle of numbers and neither side twice; a link that many notes
    share is summed on the map side.
    """
    ids = events.select(F.col("event_id").alias("id"), F.lit(0).alias("notes"), F.lit(1).alias("events"))
    links = notes.filter(F.col("linked_event_id").isNotNull()).select(F.col("linked_event_id").alias("id"), F.lit(1).alias("notes"), F.lit(0).alias("events"))
    each = ids.unionByName(links).groupBy("id").agg(F.sum("notes").alias("notes"), F.sum("events").alias("events"))
    named = F.col("id").isNotNull() & (F.col("notes") > 0)
    totals = each.agg(
        F.coalesce(F.sum("notes"), F.lit(0)).alias("linked_notes"),
        F.count_if(named & (F.col("events") > 0)).alias("linked_event_count"),
        F.count_if(named & (F.col("events") == 0) & (F.col("id") != "")).alias("orphan_link_count"),
        F.coalesce(F.sum("events"), F.lit(0)).alias("total_events"),
    )
    share = F.col("linked_event_count").cast("double") / F.greatest(F.lit(1), F.col("total_events")).cast("double")
    return totals.withColumn("coverage_ratio", half_up(share, 4))


def orphan_links(events: DataFrame, notes: DataFrame, limit: int | None = None) -> DataFrame:
    """All orphan link ids; with a limit the first ones in order."""
    orphans = (
        notes.filter(F.col("linked_event_id") != "")
        .select("linked_event_id")
        .distinct()
        .join(events.select(F.col("event_id").alias("linked_event_id")), "linked_event_id", "left_anti")
    )
    return orphans if limit is None else orphans.orderBy("linked_event_id").limit(limit)


def link_breakdown(notes: DataFrame) -> DataFrame:
    """Notes by severity and by event type."""
    kinds = F.array(
        F.struct(F.lit("severity").alias("dimension"), F.coalesce("severity", F.lit("unknown")).alias("label")),
        F.struct(F.lit("event_type").alias("dimension"), F.coalesce("event_type", F.lit("event")).alias("label")),
    )
    return (
        notes.select(F.explode(kinds).alias("k"))
        .groupBy("k.dimension", "k.label")
        .agg(F.count(F.lit(1)).alias("notes"))
    )


def event_windows(df: DataFrame, window: str, group: Sequence[str], value: str, time: str = "ts") -> DataFrame:
    """Counts and sums per event-time window; works on batches and on watermarked streams."""
    return (
        df.groupBy(F.window(time, window).alias("w"), *group)
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.sum(F.col(value).cast("decimal(28,6)")).cast("double").alias("value_sum"),
        )
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            *group, "events", "value_sum",
        )
    )


def sessions(df: DataFrame, gap: str, group: Sequence[str], value: str, time: str = "ts") -> DataFrame:
    """Counts and sums per session: events of a group at most ``gap`` apart; a session ends ``gap`` after its last event."""
    return (
        df.groupBy(F.session_window(time, gap).alias("w"), *group)
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.sum(F.col(value).cast("decimal(28,6)")).cast("double").alias("value_sum"),
        )
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("session_start"),
            F.col("w.end").cast("timestamp_ntz").alias("session_end"),
            *group, "events", "value_sum",
        )
    )


def event_sessions(df: DataFrame, gap: str, group: Sequence[str], value: str, time: str = "ts", slice_of: str = "1 day") -> DataFrame:
    """The sessions of a table, in two steps, so that a group with a third of all events is many groups.

    Events are merged to sessions inside slices of time first; what is left, a row per session and slice, is merged across
    slices where it touches. Rows without a time belong to no session.
    """
    timed = df.filter(F.col(time).isNotNull()).withColumn("_slice", F.window(time, slice_of)["start"])
    exact = timed.withColumn("_value", F.col(value).cast("decimal(28,6)"))
    parts = exact.groupBy(F.session_window(time, gap).alias("w"), "_slice", *group).agg(
        F.count(F.lit(1)).alias("events"), F.sum("_value").alias("value_sum")
    ).select(*group, F.col("w.start").alias("_start"), F.col("w.end").alias("_end"), "events", "value_sum")
    order = Window.partitionBy(*group).orderBy("_start", "_end")
    # Parts of one slice are apart already, so the part before is the only one that can reach.
    opens = F.when(F.col("_start") <= F.lag("_end").over(order), 0).otherwise(1)
    numbered = parts.withColumn("_opens", opens).withColumn("_number", F.sum("_opens").over(order))
    return numbered.groupBy(*group, "_number").agg(
        F.min("_start").cast("timestamp_ntz").alias("session_start"), F.max("_end").cast("timestamp_ntz").alias("session_end"),
        F.sum("events").alias("events"), F.sum("value_sum").cast("double").alias("value_sum"),
    ).select("session_start", "session_end", *group, "events", "value_sum")


def beyond_allowed(allowed: str) -> Column:
    """Whether a late event came past the allowed delay."""
    delay = F.col("ts") - F.coalesce("event_ts_original", "ts")
    return F.col("late_arrival") & (delay > F.expr(f"INTERVAL {allowed}"))


def late_report(df: DataFrame, window: str, allowed: str) -> DataFrame:
    """Per original event window: events, late ones, and late ones past the allowed delay."""
    event_time = F.coalesce("event_ts_original", "ts")
    beyond = beyond_allowed(allowed)
    return (
        df.groupBy(F.window(event_time, window).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count_if(F.col("late_arrival")).alias("late_events"),
            F.count_if(beyond).alias("beyond_allowed"),
        )
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "events", "late_events", "beyond_allowed")
    )
