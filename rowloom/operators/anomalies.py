"""Cell and row anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions import rng

# Anomaly names, the ones used by default, and the planted values.
NULL_FIELD = "null_field"
EMPTY_STRING = "empty_string"
INVALID_ENUM = "invalid_enum"
MALFORMED_STRING = "malformed_string"
DUPLICATE_ROW = "duplicate_row"
DEFAULT_TYPES = (NULL_FIELD, EMPTY_STRING, INVALID_ENUM, MALFORMED_STRING)
INVALID_VALUE = "__INVALID__"
MALFORMED_VALUE = "\x00\xff\xfe broken \x00"


def effective_ratio(ratio: float, profile: str) -> float:
    """Clean sources keep anomalies rare, chaotic ones have at least five percent."""
    if profile == "clean":
        return min(ratio, 0.01)
    if profile == "chaotic":
        return max(ratio, 0.05)
    return ratio


def text_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]


def plant(
    df: DataFrame, key: str, hit: Column, kinds: Sequence[str], seed: int, table: str, skip: Sequence[str] = (),
) -> DataFrame:
    """Put one anomaly into one cell of every hit row.

    Nulls may fall into any column; empty and malformed text falls into a non-null
    text cell; an invalid enum value needs a text column to hold it.
    """
    cells = [k for k in kinds if k != DUPLICATE_ROW]
    names = [c for c in df.columns if c not in skip]
    texts = text_columns(df, skip)
    filled = ", ".join(f"IF(`{c}` IS NOT NULL, {i}, NULL)" for i, c in enumerate(texts))
    staged = df.withColumns(
        {
            "_kind": F.when(hit, rng.choose(seed, f"{table}.anomaly.kind", key, list(kinds))),
            "_any": rng.randint(seed, f"{table}.anomaly.column", key, 0, max(len(names), 1) - 1),
            "_enum": rng.randint(seed, f"{table}.anomaly.enum", key, 0, max(len(texts), 1) - 1),
            "_draw": rng.draw(seed, f"{table}.anomaly.text", key),
        }
    )
    if texts:
        # Only rows that need it look for their non-null text cells.
        staged = staged.withColumn(
            "_filled", F.expr(f"IF(_kind IN ('{EMPTY_STRING}', '{MALFORMED_STRING}'), array_compact(array({filled})), NULL)")
        ).withColumn("_text", F.expr("get(_filled, int(shiftright(_draw * size(_filled), 32)))"))
    columns = []
    for name in df.columns:
        cases = []
        if name in names and NULL_FIELD in cells:
            cases.append(f"WHEN _kind = '{NULL_FIELD}' AND _any = {names.index(name)} THEN NULL")
        if name in texts:
            at = texts.index(name)
            for kind, where, text in (
                (INVALID_ENUM, "_enum", INVALID_VALUE),
                (EMPTY_STRING, "_text", ""),
                (MALFORMED_STRING, "_text", MALFORMED_VALUE),
            ):
                if kind in cells:
                    cases.append(f"WHEN _kind = '{kind}' AND {where} = {at} THEN {_escaped(text)}")
        value = f"`{name}`"
        columns.append(
            f"CASE WHEN _kind IS NULL THEN {value} {' '.join(cases)} ELSE {value} END AS {value}" if cases else value
        )
    return staged.selectExpr(*columns)


def _escaped(text: str) -> str:
    """SQL literal in which every character outside plain ASCII is escaped."""
    return "'" + "".join(c if " " <= c <= "~" and c not in "'\\" else f"\\u{ord(c):04x}" for c in text) + "'"


def append_duplicates(df: DataFrame, chosen: Column) -> DataFrame:
    """Add a copy of every chosen row; the table is read once."""
    return with_copies(df, chosen, "_copy").drop("_copy")


def with_copies(df: DataFrame, chosen: Column, mark: str) -> DataFrame:
    """As :func:`append_duplicates`, with ``mark`` 0 for the row and 1 for its copy."""
    return df.withColumn(mark, F.explode(F.when(chosen, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))


def inject_anomalies(
    df: DataFrame, key: str, ratio: float, seed: int, table: str, kinds: Sequence[str] = DEFAULT_TYPES,
    hit: Column | None = None, skip: Sequence[str] = (),
) -> DataFrame:
    """A mix of anomalies in about ``ratio`` of the rows, or in exactly the ``hit`` rows."""
    if ratio <= 0:
        return df
    if hit is None:
        hit = rng.below(ratio, seed, f"{table}.anomaly.row", key)
    planted = plant(df, key, hit, kinds, seed, table, skip)
    if DUPLICATE_ROW not in kinds:
        return planted
    copied = hit & (rng.choose(seed, f"{table}.anomaly.kind", key, list(kinds)) == DUPLICATE_ROW)
    return append_duplicates(planted, copied)
