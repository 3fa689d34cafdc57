"""Registered queries: each runs operators on the given tables and has a SQL twin where one exists."""

from __future__ import annotations

from importlib import import_module

FAMILIES = (
    "scans", "generation", "degradation", "quality", "reconciliation", "runs", "eventing", "outputs", "streams",
)


def load() -> dict:
    """Import all families and return the registry."""
    for family in FAMILIES:
        import_module(f"rowloom.suite.{family}")
    from rowloom.suite.registry import QUERIES

    return QUERIES
