"""Event times inside a window, as microsecond offsets from its start.

Offsets are whole microseconds, so that every engine sees the same order of events.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions import rng

PATTERNS = ("steady", "burst", "seasonal", "growth")
# Patterns whose times already rise with the event position.
RISING = ("growth",)


def offset_micros(pattern: str, position: str, count: int, span_micros: int, seed: int) -> Column:
    """Offset of the event at ``position`` among ``count`` events."""
    span = F.lit(float(span_micros))
    u = rng.uniform(seed, f"time.{pattern}", position)
    at = F.expr(position)
    if pattern == "burst":
        quiet = count - int(count * 0.3)
        late = span * F.lit(0.9) + span * F.lit(0.1) * u
        return F.floor(F.when(at < quiet, span * u).otherwise(late))
    if pattern == "seasonal":
        share = at.cast("double") / F.lit(float(max(count, 1)))
        quarter = F.floor(share * 4.0).cast("int")
        weight = F.when(quarter % 2 == 0, F.lit(1.0)).otherwise(F.lit(0.65))
        jitter = span * F.lit(0.05) * (u - 0.5) * weight
        return F.floor(F.least(span, F.greatest(F.lit(0.0), span * share + jitter)))
    if pattern == "growth":
        share = F.sqrt((at.cast("double") + u) / F.lit(float(max(count, 1))))
        return F.floor(span * F.least(F.lit(1.0), share))
    return F.floor(span * u)


def at_offset(start: str, micros: Column) -> Column:
    """Timestamp without time zone at an offset from ``start``."""
    seconds = F.floor(micros / F.lit(1_000_000)).cast("bigint")
    rest = micros - seconds * 1_000_000
    days = F.floor(seconds / F.lit(86_400)).cast("int")
    in_day = (seconds - days.cast("bigint") * 86_400).cast("decimal(12,6)") + (
        rest.cast("decimal(12,0)") / F.lit(1_000_000).cast("decimal(12,0)")
    ).cast("decimal(12,6)")
    return F.to_timestamp_ntz(F.lit(start)) + F.make_dt_interval(days=days, secs=in_day)
