"""Operators that differ between streams and batches.

Row-wise operators (change tags, masking, row rules, late arrivals, contracts) are
used on streams as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, IntegralType, LongType, StringType, StructField, StructType

from rowloom.operators.events import beyond_allowed, event_windows, sessions
from rowloom.operators.rules import row_violations
from rowloom.plans.joins import without_match
from rowloom.plans.spec import BusinessRule


def keep_first_in_watermark(df: DataFrame, key: Sequence[str], time: str, delay: str) -> DataFrame:
    """Drop repeats of a key that arrive within the delay; state older than that is discarded."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def closed_windows(df: DataFrame, window: str, delay: str, group: Sequence[str], value: str, time: str = "ts") -> DataFrame:
    """Windowed totals, emitted once the watermark has passed a window's end."""
    return event_windows(df.withWatermark(time, delay), window, group, value, time)


def stream_orphans(
    child: DataFrame, child_column: str, parent: DataFrame, parent_column: str, hot: DataFrame | None = None
) -> DataFrame:
    """Arriving rows whose foreign key is missing in a static parent table.

    ``hot`` may name foreign keys known to be frequent, which then are not shuffled.
    """
    keys = parent.select(F.col(parent_column).alias(child_column))
    return without_match(child, keys, [child_column], hot)


def linked_notes(events: DataFrame, notes: DataFrame, delay: str, within: str, how: str = "inner") -> DataFrame:
    """Notes joined to their events on two streams; each side waits at most ``within``.

    With ``how`` as ``left_outer`` notes without an event come out too, once the watermark says that none can follow.
    """
    left = notes.withWatermark("note_ts", delay)
    right = events.withWatermark("ts", delay)
    near = F.expr(f"note_ts >= ts AND note_ts <= ts + INTERVAL {within}")
    return left.join(right, (F.col("linked_event_id") == F.col("event_id")) & near, how)


def unlinked_notes(events: DataFrame, notes: DataFrame, delay: str, within: str) -> DataFrame:
    """Notes whose event hasn't come ``within`` the time they wait for it; notes that name no event never get one."""
    joined = linked_notes(events, notes, delay, within, "left_outer")
    return joined.filter(F.col("event_id").isNull()).select(*notes.columns)


def rule_counts(df: DataFrame, table: str, rules: Sequence[BusinessRule]) -> DataFrame:
    """Running violations of all row rules of a stream, in update mode: one row of state, whatever arrives."""
    return row_violations(df, table, rules)


def closed_sessions(df: DataFrame, gap: str, delay: str, group: Sequence[str], value: str, time: str = "ts") -> DataFrame:
    """Sessions of events at most ``gap`` apart, emitted once the watermark has passed their end."""
    return sessions(df.withWatermark(time, delay), gap, group, value, time)


def split_orphans(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> Callable[[DataFrame], DataFrame]:
    """A step for ``run_batches``: rows of a micro-batch whose foreign key is missing in the parent table.

    Frequent keys are counted in every batch and met by broadcast, so that what is hot today needn't be known before and
    isn't gathered in one task; a small parent is broadcast as a whole.
    """
    keys = parent.select(F.col(parent_column).alias(child_column))
    columns = child.columns
    return lambda batch: without_match(batch, keys, [child_column]).select(*columns)


def observed_late(df: DataFrame, allowed: str, name: str = "late") -> DataFrame:
    """Measure events, late ones and those past the allowed delay while a stream of ``late_arrivals`` runs."""
    return df.observe(
        name, F.count(F.lit(1)).alias("events"), F.count_if("late_arrival").alias("late_events"), F.count_if(beyond_allowed(allowed)).alias("beyond_allowed")
    )


#: Cells survive the way through state as text.
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


#: Groups that keys are dealt into by hash: calling Python once for every key costs far more than its rows do.
KEY_GROUPS = 4096
#: In place of the time of a row without one.
NO_TIME = -(1 << 62)


def keep_least_in_watermark(df: DataFrame, key: Sequence[str], order: str, time: str, delay: str, groups: int = KEY_GROUPS) -> DataFrame:
    """Of every key the row that comes first in an order, whenever it arrives.

    State holds the best row of a key so far. A key is settled when the watermark, ``delay`` behind the newest event, passes its
    newest event: then its row comes out and its state goes, so state holds only keys of the last while. A key that is
    seen again after that starts anew. Of equal order values the first that arrived stays; rows without an order value come
    last, rows without an event time never settle a key. Null keys are one key.

    The keys of a group share one state, which a batch with any of them reads and writes whole. ``groups`` has to stay
    the same for a query that goes on from its checkpoint.
    """
    row, field = "_row", df.schema[order]
    value = F.col(f"`{order}`")
    if isinstance(field.dataType, IntegralType):
        # With nulls among them pandas would hold whole numbers as doubles.
        value = F.coalesce(value, F.lit(0).cast(field.dataType))
    shown = df.withWatermark(time, delay).withColumn("_key", F.to_json(F.struct(*[F.col(f"`{c}`") for c in key]), EXACT)).select(
        F.pmod(F.xxhash64("_key"), F.lit(groups)).alias("_group"), "_key", F.col(time).alias(time),
        F.coalesce(F.unix_millis(F.col(time)), F.lit(NO_TIME)).alias("_ms"), F.col(f"`{order}`").isNotNull().alias("_ordered"),
        value.alias("_order"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), EXACT).alias(row),
    )
    of_key = StructType([
        StructField("key", StringType()), StructField("order", field.dataType), StructField("due", LongType()), StructField("row", StringType()),
    ])
    state = StructType([StructField("keys", ArrayType(of_key))])

    def least(_: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        passed = held.getCurrentWatermarkMs()
        # Per key: the best order value and its row, and when the key is settled.
        kept: dict[str, tuple[Any, int | None, str]] = {k: (o, due, cells) for k, o, due, cells in held.get[0]} if held.exists else {}
        met = set()
        for batch in () if held.hasTimedOut else batches:
            orders = batch["_order"].astype(object).where(batch["_ordered"] & batch["_order"].notna(), None).tolist()
            for k, o, ms, cells in zip(batch["_key"].tolist(), orders, batch["_ms"].tolist(), batch[row].tolist(), strict=True):
                best, due, best_cells = kept.get(k, (None, None, None))
                if best_cells is None or (o is not None and (best is None or o < best)):
                    best, best_cells = o, cells
                if ms != NO_TIME:
                    due = ms + 1 if due is None else max(due, ms + 1)
                kept[k] = (best, due if due is None else max(due, passed + 1), best_cells)
                met.add(k)
        # Keys of this batch wait for the next one.
        settled = [k for k, (_, due, _) in kept.items() if due is not None and due < passed and k not in met]
        if settled:
            yield pd.DataFrame({row: [kept.pop(k)[2] for k in settled]})
        if not kept:
            held.remove()
            return
        held.update(([(k, *rest) for k, rest in kept.items()],))
        dues = [due for _, due, _ in kept.values() if due is not None]
        if dues:
            held.setTimeoutTimestamp(min(dues))

    out = shown.groupBy("_group").applyInPandasWithState(least, f"{row} string", state, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.from_json(row, df.schema, EXACT).alias("r")).select("r.*")
