"""Seeded, portable pseudo-random draws as plain column arithmetic.

A draw depends only on ``(seed, tag, key)``: never on the partition, the task or
the order of rows. Re-running a lost task, slicing a table or changing the number
of partitions therefore gives the same values, and independent columns simply use
different tags. Everything is BIGINT arithmetic, so it stays in generated code.

``key`` is the SQL text of a non-negative integer expression, usually a column name.
One parsed expression per draw keeps plan building cheap for wide tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW32 = 0xFFFFFFFF
TWO32 = 4294967296
MIX = 73244475
HIGH_MIX = 2654435769


def salts(seed: int, tag: str) -> tuple[int, int]:
    """Two 32-bit constants of a ``(seed, tag)`` stream, stable across processes."""
    digest = hashlib.md5(f"{seed}/{tag}".encode()).digest()
    return int.from_bytes(digest[:4], "big"), int.from_bytes(digest[4:8], "big")


def draw_text(seed: int, tag: str, key: str) -> str:
    """SQL text of :func:`draw`.

    Two rounds of xor-shift and multiplication, each with its own constant, so streams
    are not shifted copies of each other. The upper half of the key enters in the second
    round, so tables beyond 2**32 rows do not repeat their values.
    """
    shift, flip = salts(seed, tag)
    key = f"bigint({key})"
    start = f"(({key} + {shift}L) & {LOW32}L)"
    first = f"((({start} ^ shiftright({start}, 16)) * {MIX}L) & {LOW32}L)"
    upper = f"((shiftright({key}, 32) * {HIGH_MIX}L) & {LOW32}L)"
    second = f"((({first} ^ shiftright({first}, 16) ^ {upper} ^ {flip}L) * {MIX}L) & {LOW32}L)"
    return f"({second} ^ shiftright({second}, 16))"


def uniform_text(seed: int, tag: str, key: str) -> str:
    return f"({draw_text(seed, tag, key)} / {TWO32}.0D)"


def randint_text(seed: int, tag: str, key: str, low: int, high: int) -> str:
    span = high - low + 1
    if span <= 0:
        raise ValueError(f"empty integer range [{low}, {high}]")
    if span <= 2**31:
        return f"(shiftright({draw_text(seed, tag, key)} * {span}L, 32) + ({low}L))"
    upper, lower = draw_text(seed, tag, key), draw_text(seed, tag + "+", key)
    return f"((shiftleft(shiftright({upper}, 1), 31) + shiftright({lower}, 1)) % {span}L + ({low}L))"


def literal(value: Any) -> str:
    """SQL text of a plain Python value."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"{value}L" if abs(value) >= 2**31 else str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def draw(seed: int, tag: str, key: str) -> Column:
    """Integer in ``[0, 2**32)``."""
    return F.expr(draw_text(seed, tag, key))


def uniform(seed: int, tag: str, key: str) -> Column:
    """Double in ``[0, 1)``."""
    return F.expr(uniform_text(seed, tag, key))


def below(chance: float, seed: int, tag: str, key: str) -> Column:
    """True with the given chance."""
    return F.expr(f"{uniform_text(seed, tag, key)} < {float(chance)!r}D")


def randint(seed: int, tag: str, key: str, low: int, high: int) -> Column:
    """Integer in ``[low, high]``, both ends included."""
    return F.expr(randint_text(seed, tag, key, low, high))


def choose(seed: int, tag: str, key: str, options: Sequence[Any]) -> Column:
    """One of the options with equal chances."""
    if not options:
        return F.lit(None)
    listed = ", ".join(literal(option) for option in options)
    return F.expr(f"get(array({listed}), int({randint_text(seed, tag, key, 0, len(options) - 1)}))")


def choose_weighted(
    seed: int, tag: str, key: str, options: Sequence[Any], weights: Sequence[float] | None
) -> Column:
    """One of the options with chances proportional to the weights."""
    if not weights or len(weights) != len(options):
        return choose(seed, tag, key, options)
    if sum(weights) <= 0:
        raise ValueError("weights must have a positive sum")
    listed = ", ".join(literal(option) for option in options)
    return F.expr(f"get(array({listed}), {band_text(uniform_text(seed, tag, key), bounds(weights))})")


def bounds(weights: Sequence[float]) -> list[float]:
    """Upper ends in ``[0, 1)`` of all weighted bands but the last."""
    total, reached, ends = float(sum(weights)), 0.0, []
    for weight in weights[:-1]:
        reached += weight
        ends.append(reached / total)
    return ends


def band_text(point: str, ends: Sequence[float]) -> str:
    """SQL text of the zero-based band a point falls into.

    A sum of comparisons instead of a CASE: all of them are evaluated, so the draw
    is computed once however many bands there are.
    """
    return "(0" + "".join(f" + int({point} >= {end!r}D)" for end in ends) + ")"


def text_key(*columns: Column) -> Column:
    """Non-negative 60-bit integer key for rows without an integer key."""
    joined = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("bigint")


def driver_draw(seed: int, tag: str, position: int) -> int:
    """The same kind of 32-bit draw for small plan decisions taken on the driver."""
    return salts(seed, f"{tag}/{position}")[0]
