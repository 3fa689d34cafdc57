"""Schema drift: planned on the driver from metadata, applied as projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import rng

# Events per profile.
PROFILE_EVENTS = {"none": 0, "mild": 1, "moderate": 2, "aggressive": 4}
EVENT_KINDS = ("add_column", "rename_column", "change_type", "nullability_change")

LOG_SCHEMA = (
    "event_no int, table_name string, event_type string, column_name string, from_value string, to_value string"
)


@dataclass(frozen=True)
class DriftEvent:
    table: str
    kind: str
    column: str
    before: str | None = None
    after: str | None = None


def plan_drift(tables: Mapping[str, Sequence[tuple[str, str]]], profile: str, seed: int) -> list[DriftEvent]:
    """Decide the events for tables given as ``{name: [(column, type), ...]}``."""
    budget = min(PROFILE_EVENTS[profile], sum(len(columns) for columns in tables.values()))
    if budget == 0:
        return []
    per_table = max(1, budget // len(tables))
    events: list[DriftEvent] = []
    for table, declared in tables.items():
        columns = [list(c) for c in declared]
        for step in range(per_table if columns else 0):
            tag = f"{table}.drift"
            kind = EVENT_KINDS[rng.driver_draw(seed, tag + ".kind", step) % len(EVENT_KINDS)]
            column = columns[rng.driver_draw(seed, tag + ".column", step) % len(columns)]
            if kind == "add_column":
                if rng.driver_draw(seed, tag + ".add", step) % 2:
                    continue
                name = f"_drift_{seed}_{len(events)}"
                columns.append([name, "string"])
                events.append(DriftEvent(table, kind, name))
            elif kind == "rename_column":
                renamed = f"{column[0]}_renamed"
                events.append(DriftEvent(table, kind, column[0], column[0], renamed))
                column[0] = renamed
            elif kind == "change_type":
                before = column[1]
                column[1] = {"integer": "string", "string": "integer"}.get(before, before)
                events.append(DriftEvent(table, kind, column[0], before, column[1]))
            else:
                events.append(DriftEvent(table, kind, column[0]))
    return events


def add_column(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.lit(None).cast("string"))


def rename_column(df: DataFrame, name: str, to: str) -> DataFrame:
    return df.withColumnRenamed(name, to)


def change_type(df: DataFrame, name: str, to: str) -> DataFrame:
    """Integers become text. Text becomes a number where it is all digits, else null
    with the old text kept in ``<name>_unparsed``: a column holds one type."""
    value = F.col(name)
    if to == "string":
        return df.withColumn(name, value.cast("string"))
    if to == "integer":
        digits = value.rlike("^[0-9]+$")
        parsed = F.when(digits, value.try_cast("bigint"))
        return df.withColumns({name: parsed, f"{name}_unparsed": F.when(parsed.isNull(), value)})
    return df


def apply_drift(df: DataFrame, table: str, events: Sequence[DriftEvent]) -> DataFrame:
    for event in events:
        if event.table != table:
            continue
        if event.kind == "add_column":
            df = add_column(df, event.column)
        elif event.kind == "rename_column":
            df = rename_column(df, event.column, event.after)
        elif event.kind == "change_type" and event.before != event.after:
            df = change_type(df, event.column, event.after)
    return df


def renamed_keys(columns: Sequence[str], table: str, events: Sequence[DriftEvent]) -> list[str]:
    """Key columns under their names after drift, so that later checks still find them."""
    names = list(columns)
    for event in events:
        if event.table == table and event.kind == "rename_column":
            names = [event.after if n == event.column else n for n in names]
    return names


def drift_log(spark: SparkSession, events: Sequence[DriftEvent]) -> DataFrame:
    rows = [(i, e.table, e.kind, e.column, e.before, e.after) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, LOG_SCHEMA)


def drift_summary(log: DataFrame, sizes: DataFrame) -> DataFrame:
    """Events per type and the rows of the tables they touched; ``sizes`` holds row counts."""
    return log.join(sizes, "table_name").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.sum("row_count").alias("affected_rows")
    )
