"""How many rows each table of a dataset gets: a protocol, planners by name, and a planner by relationships."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from rowloom.plans.spec import DatasetSpec, plan_row_counts


@runtime_checkable
class RowPlanner(Protocol):
    """Anything that tells the rows of each table from a dataset and its scale."""

    def plan_row_counts(self, spec: DatasetSpec, scale: int, only: Sequence[str] | None = None) -> dict[str, int]: ...


class ByName:
    """Rows from table names, see ``plan_row_counts``."""

    def plan_row_counts(self, spec: DatasetSpec, scale: int, only: Sequence[str] | None = None) -> dict[str, int]:
        return plan_row_counts(spec, scale, only)


@dataclass(frozen=True)
class PerParent:
    """Rows from relationships: a table without parents gets the scale, any other so many rows for each row of its first parent.

    ``children`` holds rows per parent row by ``child`` or ``(child, parent)``, one where nothing is said; ``roots`` replaces
    the scale of tables without parents. Tables that refer to each other in a circle raise an error.
    """

    children: Mapping[str | tuple[str, str], float] = field(default_factory=dict)
    roots: Mapping[str, int] = field(default_factory=dict)

    def plan_row_counts(self, spec: DatasetSpec, scale: int, only: Sequence[str] | None = None) -> dict[str, int]:
        counts: dict[str, int] = {}
        for name in spec.load_order():
            parents = [fk.parent for fk in spec.foreign_keys if fk.child == name and fk.parent != name]
            if not parents:
                counts[name] = self.roots.get(name, scale)
                continue
            ratio = self.children.get((name, parents[0]), self.children.get(name, 1))
            counts[name] = round(counts[parents[0]] * ratio)
        return {name: n for name, n in counts.items() if not only or name in only}


_PLANNERS: dict[str, RowPlanner] = {"by_name": ByName(), "per_parent": PerParent()}


def register_row_planner(name: str, planner: RowPlanner) -> None:
    """Add or replace a planner."""
    if not isinstance(planner, RowPlanner):
        raise TypeError("a row planner has a method plan_row_counts")
    _PLANNERS[name] = planner


def row_planner(chosen: str | RowPlanner) -> RowPlanner:
    """A planner by its name, or the one that is given."""
    if not isinstance(chosen, str):
        return chosen
    if chosen not in _PLANNERS:
        raise ValueError(f"unknown row planner {chosen!r}, expected one of {', '.join(sorted(_PLANNERS))}")
    return _PLANNERS[chosen]


def planned_rows(chosen: str | RowPlanner, spec: DatasetSpec, scale: int, only: Sequence[str] | None = None) -> dict[str, int]:
    """What a planner says, checked: only tables of the dataset, and whole numbers of rows."""
    counts = dict(row_planner(chosen).plan_row_counts(spec, scale, only))
    known = {t.name for t in spec.tables}
    for name, rows in counts.items():
        if name not in known:
            raise ValueError(f"the row planner names {name}, which the dataset lacks")
        if isinstance(rows, bool) or not isinstance(rows, int) or rows < 0:
            raise ValueError(f"the row planner gives {name} {rows!r} rows")
    return counts
