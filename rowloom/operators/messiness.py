"""Formatting faults of source systems, on raw (all-text) tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions import rng
from rowloom.functions.text import as_text

# Share of rows touched, and the upper end of each fault's band in [0, 1).
ROW_SHARE = {"realistic": 0.15, "chaotic": 0.4}
BANDS = {
    "realistic": [("whitespace", 0.25), ("casing", 0.4), ("dates", 0.65)],
    "chaotic": [("whitespace", 0.25), ("casing", 0.4), ("numbers", 0.5), ("dates", 0.65), ("enums", 0.8)],
}
# Alternative spellings of common status words.
SPELLINGS = {"active": "Active", "pending": "PENDING", "canceled": "cancelled", "paid": "Paid"}

ISO_DAY = r"^\d{4}-\d{2}-\d{2}[^-T]*(T|$)"
DAY_PARTS = r"^(\d{4})-(\d{2})-(.*)$"


def to_raw(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Render every column as text, except those in ``keep``."""
    return df.select(
        *[
            F.col(f.name) if f.name in keep else as_text(F.col(f.name), f.dataType).alias(f.name)
            for f in df.schema.fields
        ]
    )


def row_draw_text(seed: int, table: str, key: str) -> str:
    return rng.draw_text(seed, f"{table}.mess.cells", key)


def cell_draw_text(table: str, column: str, row_draw: str) -> str:
    """SQL text of a cell's draw: one more mixing round over the row's draw.

    One draw decides about a cell: its size whether, its lowest bit how.
    """
    return _mixed(row_draw, _flip(table, column))


def _flip(table: str, column: str) -> str:
    return f"{rng.salts(0, f'{table}.{column}')[0]}L"


def _mixed(row_draw: str, flip: str) -> str:
    mixed = f"((({row_draw} ^ {flip}) * {rng.MIX}L) & {rng.LOW32}L)"
    return f"({mixed} ^ shiftright({mixed}, 16))"


def _hit(cell: str, chance: float) -> str:
    return f"{cell} < {int(chance * rng.TWO32)}L"


def _coin(cell: str) -> str:
    return f"({cell} & 1L) = 0L"


# Each fault takes the SQL text of a value and of its cell draw and gives the text of the changed value.


def whitespace(value: str, cell: str) -> str:
    changed = f"CASE WHEN {_coin(cell)} THEN concat('  ', {value}) ELSE concat({value}, '\\t ') END"
    return f"CASE WHEN length({value}) > 0 AND {_hit(cell, 0.5)} THEN {changed} ELSE {value} END"


def casing(value: str, cell: str) -> str:
    changed = f"CASE WHEN {_coin(cell)} THEN lower({value}) ELSE upper({value}) END"
    return f"CASE WHEN length({value}) > 2 AND {_hit(cell, 0.4)} THEN {changed} ELSE {value} END"


def number_hit(value: str, cell: str) -> str:
    """Whether a numeric cell arrives as text."""
    return f"({value} IS NOT NULL AND {_hit(cell, 0.5)})"


def date_format(value: str, cell: str) -> str:
    parts = f"regexp_replace(substring_index({value}, 'T', 1), {rng.literal(DAY_PARTS)}"
    changed = f"CASE WHEN {_coin(cell)} THEN {parts}, '$2/$3/$1') ELSE {parts}, '$2-$3-$1') END"
    return f"CASE WHEN {_hit(cell, 0.5)} AND {value} RLIKE {rng.literal(ISO_DAY)} THEN {changed} ELSE {value} END"


def enum_spelling(value: str, cell: str) -> str:
    cases = " ".join(f"WHEN '{plain}' THEN '{other}'" for plain, other in SPELLINGS.items())
    return f"CASE WHEN {_hit(cell, 0.5)} THEN CASE lower({value}) {cases} ELSE {value} END ELSE {value} END"


MUTATORS = {"whitespace": whitespace, "casing": casing, "dates": date_format, "enums": enum_spelling}


def apply_messiness(
    df: DataFrame, key: str, profile: str, seed: int, table: str, touched: Column | None = None,
    number_columns: Sequence[str] = (), skip: Sequence[str] = (),
) -> DataFrame:
    """Apply one fault to each touched row.

    ``touched`` selects the rows; without it about ``ROW_SHARE`` of them are taken.
    Numeric cells stay text in a raw table; with a profile that has the numbers fault
    an ``as_text_columns`` count says how many of a row's numbers arrived quoted.
    """
    if profile == "clean":
        return df
    if touched is None:
        touched = rng.below(ROW_SHARE[profile], seed, f"{table}.mess.row", key)
    names = [name for name, _ in BANDS[profile]]
    band = rng.band_text(rng.uniform_text(seed, f"{table}.mess.kind", key), [end for _, end in BANDS[profile]])
    texts = [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in skip and f.name not in number_columns
    ]
    numbers = list(number_columns) if "numbers" in names else []
    # Drawn in projections of their own, so every draw is computed once. The band beyond the last fault is none.
    staged = df.withColumns(
        {"_touched": touched, "_band": F.expr(band), "_row": F.expr(row_draw_text(seed, table, key))}
    ).withColumns({"_fault": F.expr(f"IF(_touched AND _band < {len(names)}, _band, -1)")})
    # Only touched rows draw for their cells. Draws and texts are arrays, so that a fault is written once and not once per column:
    # that makes generated methods of more than 8,000 bytes, which the JVM doesn't compile.
    flips = ", ".join(_flip(table, c) for c in [*texts, *numbers])
    draws = f"IF(_fault >= 0, transform(array({flips}), flip -> {_mixed('_row', 'flip')}), NULL) AS _cells"
    drawn = staged.select(*df.columns, "_fault", F.expr(draws))
    faults = " ".join(
        f"WHEN _fault = {i} THEN {MUTATORS[fault]('cell', 'get(_cells, at)')}" for i, fault in enumerate(names) if fault in MUTATORS
    )
    held = ", ".join(f"`{c}`" for c in texts)
    if texts:
        shaken = f"IF(_fault >= 0, transform(array({held}), (cell, at) -> CASE {faults} ELSE cell END), NULL) AS _texts"
        drawn = drawn.select("*", F.expr(shaken))
    columns = [f"IF(_fault >= 0, get(_texts, {texts.index(c)}), `{c}`) AS `{c}`" if c in texts else f"`{c}`" for c in df.columns]
    if numbers:
        quoted = " + ".join(f"int({number_hit(f'`{c}`', f'get(_cells, {i})')})" for i, c in enumerate(numbers, len(texts)))
        columns.append(f"IF(_fault = {names.index('numbers')}, {quoted}, 0) AS as_text_columns")
    return drawn.selectExpr(*columns)
