"""The degrading and refining operators chained in the order data really goes through."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions import rng
from rowloom.functions.text import as_text
from rowloom.operators.anomalies import inject_anomalies
from rowloom.operators.change_tags import tag_cdc
from rowloom.operators.drift import DriftEvent, apply_drift, plan_drift, renamed_keys
from rowloom.operators.layers import to_layer
from rowloom.operators.messiness import apply_messiness, to_raw
from rowloom.operators.privacy import redact
from rowloom.operators.report import table_report
from rowloom.operators.selection import exact_share
from rowloom.plans.catalog import union_all
from rowloom.plans.spec import BusinessRule


@dataclass(frozen=True)
class FlowSettings:
    """Drift and messiness profiles, the share of changed rows and of rows with an anomaly."""

    seed: int
    drift: str = "mild"
    messiness: str = "realistic"
    changed: float = 0.2
    anomalies: float = 0.02


def drift_plan(tables: Mapping[str, DataFrame], settings: FlowSettings) -> list[DriftEvent]:
    """Drift of the tables' columns; logical types decide which of them may change theirs."""
    logical = {"int": "integer", "bigint": "bigint", "string": "string", "double": "float", "timestamp_ntz": "timestamp"}
    declared = {n: [(c, logical.get(t, t)) for c, t in df.dtypes] for n, df in tables.items()}
    return plan_drift(declared, settings.drift, settings.seed)


def degrade(df: DataFrame, table: str, key: str, events: Sequence[DriftEvent], settings: FlowSettings) -> tuple[DataFrame, str]:
    """A table after drift, change tags, messiness and anomalies, and the name its key has then.

    The key is a unique whole number; its values never change, so every later step still finds its rows.
    """
    drifted = apply_drift(df, table, events)
    (key,) = renamed_keys([key], table, events)
    tagged = tag_cdc(drifted, key, rng.below(settings.changed, settings.seed, f"{table}.cdc.row", key), settings.seed, table)
    numbers = [f.name for f in tagged.schema.fields if f.name != key and f.dataType.simpleString() in ("int", "bigint", "double")]
    raw = to_raw(tagged, keep=[key])
    kept = [key, "op_type", "batch_id"]
    messy = apply_messiness(raw, key, settings.messiness, settings.seed, table, number_columns=numbers, skip=kept)
    hit = exact_share(raw, settings.anomalies, settings.seed, f"{table}.anomaly.row", key)
    return inject_anomalies(messy, key, settings.anomalies, settings.seed, table, hit=hit, skip=[key]), key


@dataclass(frozen=True)
class Flow:
    """What a run leaves: the tables per stage, the drift that happened and each table's key after it."""

    stages: Mapping[str, Mapping[str, DataFrame]]
    events: Sequence[DriftEvent]
    keys: Mapping[str, str]

    def row_counts(self) -> DataFrame:
        """``table_name, stage, row_count``."""
        return union_all([
            df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), F.lit(stage).alias("stage"), "row_count")
            for stage, tables in self.stages.items()
            for n, df in tables.items()
        ])

    def rows(self, keys: Mapping[str, str]) -> DataFrame:
        """Every row of every stage as ``table_name, stage, row_key, cells``; ``keys`` are those of the source tables.

        Cells are rendered as raw text, joined by ``|`` in the order of the columns; a null is ``-``.
        """
        made = []
        for stage, tables in self.stages.items():
            for n, df in tables.items():
                key = keys[n] if stage == "source" else self.keys[n]
                cells = [F.coalesce(as_text(F.col(f"`{f.name}`"), f.dataType), F.lit("-")) for f in df.schema.fields if f.name != key]
                made.append(df.select(
                    F.lit(n).alias("table_name"), F.lit(stage).alias("stage"), F.col(f"`{key}`").alias("row_key"),
                    F.concat_ws("|", *cells).alias("cells"),
                ))
        return union_all(made)

    def report(self, stage: str, rules: Sequence[BusinessRule] = ()) -> DataFrame:
        """Row checks of a stage, each table read once."""
        return union_all([table_report(df, n, rules, operation="op_type") for n, df in self.stages[stage].items()])


def run_flow(
    tables: Mapping[str, DataFrame], keys: Mapping[str, str], settings: FlowSettings,
    categories: Mapping[str, Mapping[str, str]] | None = None,
) -> Flow:
    """Source tables to bronze (drift, change tags, messiness, anomalies), silver, gold and a masked copy of gold.

    ``categories`` names the sensitive columns per table, as they are called after drift.
    """
    events = drift_plan(tables, settings)
    bronze, found = {}, {}
    for name, df in tables.items():
        bronze[name], found[name] = degrade(df, name, keys[name], events, settings)
    stages = {"source": tables, "bronze": bronze}
    for layer in ("silver", "gold"):
        stages[layer] = {n: to_layer(df, layer, found[n], found[n]) for n, df in bronze.items()}
    stages["shared"] = {n: redact(df, (categories or {}).get(n, {})) for n, df in stages["gold"].items()}
    return Flow(stages, events, found)
