"""Declarative table specifications.

They hold names, types and rules only; operators turn them into column expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

# Logical column types and the Spark type that stores each of them.
LOGICAL_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "text": T.StringType(),
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "float": T.DoubleType(),
    "decimal": T.DecimalType(18, 4),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "timestamp": T.TimestampNTZType(),
    "uuid": T.StringType(),
    "email": T.StringType(),
    "phone": T.StringType(),
    "url": T.StringType(),
    "json": T.StringType(),
    "enum": T.StringType(),
    "currency": T.DecimalType(18, 2),
    "percent": T.DecimalType(5, 4),
}

GENERATION_RULES = ("faker", "uuid", "sequence", "range", "static", "weighted_choice")


@dataclass(frozen=True)
class ValueRule:
    """How one column's values are made, overriding type defaults and hints."""

    kind: str
    params: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Shape:
    """A distribution laid over a generated value."""

    kind: str
    params: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str = "string"
    nullable: bool = True
    unique: bool = False
    min_length: int | None = None
    max_length: int | None = None
    min_value: float | None = None
    max_value: float | None = None
    enum: Sequence[str] = ()
    hint: str | None = None
    rule: ValueRule | None = None
    shape: Shape | None = None


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: Sequence[ColumnSpec]
    primary_key: Sequence[str] = ()

    def column(self, name: str) -> ColumnSpec:
        for column in self.columns:
            if column.name == name:
                return column
        raise KeyError(f"{self.name}.{name}")


@dataclass(frozen=True)
class ForeignKey:
    """Child columns that must hold values of the parent columns."""

    child: str
    child_columns: Sequence[str]
    parent: str
    parent_columns: Sequence[str]

    @property
    def name(self) -> str:
        return f"{self.child}.{','.join(self.child_columns)}->{self.parent}"


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    tables: Sequence[TableSpec]
    foreign_keys: Sequence[ForeignKey] = ()

    def table(self, name: str) -> TableSpec:
        for table in self.tables:
            if table.name == name:
                return table
        raise KeyError(name)

    def load_order(self) -> list[str]:
        """Parents before children, ties by name; members of a cycle come last, by name."""
        waiting = {t.name: set() for t in self.tables}
        for fk in self.foreign_keys:
            if fk.child in waiting and fk.parent in waiting and fk.child != fk.parent:
                waiting[fk.child].add(fk.parent)
        ordered: list[str] = []
        while waiting:
            ready = sorted(name for name, parents in waiting.items() if not parents & waiting.keys())
            ready = ready or sorted(waiting)
            ordered.extend(ready)
            for name in ready:
                del waiting[name]
        return ordered


@dataclass(frozen=True)
class BusinessRule:
    """A check on rows. ``kind`` is one of order, range, equality, sum, uniqueness,
    reference, enum, pattern, custom."""

    name: str
    kind: str
    table: str
    expression: str | None = None
    fields: Sequence[str] = ()
    params: Mapping[str, Any] = field(default_factory=dict)


def rule_problems(rule: ValueRule) -> list[str]:
    """Messages about wrong parameters; empty when the rule can be compiled."""
    if rule.kind not in GENERATION_RULES:
        return [f"unknown rule kind {rule.kind!r}, expected one of {', '.join(GENERATION_RULES)}"]
    params = rule.params
    found: list[str] = []

    def number(name: str) -> float | None:
        value = params.get(name)
        if value is None:
            return None
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            found.append(f"{name} must be a number")
            return None
        return float(value)

    chance = number("null_probability")
    if chance is not None and not 0 <= chance < 1:
        found.append("null_probability must be in [0, 1)")
    if rule.kind == "faker" and not (isinstance(params.get("provider"), str) and params["provider"]):
        found.append("provider must be a non-empty string")
    if rule.kind == "sequence":
        number("start")
        number("step")
    if rule.kind == "static" and "value" not in params:
        found.append("value is required")
    if rule.kind == "range":
        low, high = number("min"), number("max")
        if params.get("min") is None and params.get("max") is None:
            found.append("min or max is required")
        if low is not None and high is not None and low > high:
            found.append("min must not exceed max")
    if rule.kind == "weighted_choice":
        choices, weights = params.get("choices"), params.get("weights")
        if not isinstance(choices, (list, tuple)) or not choices:
            found.append("choices must be a non-empty list")
        elif weights is not None:
            if not isinstance(weights, (list, tuple)) or len(weights) != len(choices):
                found.append("weights must be a list as long as choices")
            elif any(not isinstance(w, (int, float)) or w < 0 for w in weights):
                found.append("weights must be non-negative numbers")
    return found


def plan_row_counts(spec: DatasetSpec, scale: int, only: Sequence[str] | None = None) -> dict[str, int]:
    """Rows per table from its name: line, item and detail tables are three times the
    scale, order-like tables twice, all others once."""
    counts = {}
    for name in spec.load_order():
        if only and name not in only:
            continue
        if name in ("orders", "invoices", "subscriptions"):
            counts[name] = scale * 2
        elif name not in ("users", "customers", "organizations", "products") and any(
            part in name for part in ("line", "item", "detail")
        ):
            counts[name] = scale * 3
        else:
            counts[name] = scale
    return counts
