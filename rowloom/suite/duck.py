"""SQL text of the seeded draws and fixed word choices, for the oracle."""

from __future__ import annotations

from collections.abc import Sequence

from rowloom.functions.rng import HIGH_MIX, LOW32, MIX, salts


def draw(seed: int, tag: str, key: str) -> str:
    shift, flip = salts(seed, tag)
    start = f"((({key})::BIGINT + {shift}) & {LOW32})"
    first = f"((xor({start}, {start} >> 16) * {MIX}) & {LOW32})"
    upper = f"(((({key})::BIGINT >> 32) * {HIGH_MIX}) & {LOW32})"
    second = f"((xor(xor(xor({first}, {first} >> 16), {upper}), {flip}) * {MIX}) & {LOW32})"
    return f"xor({second}, {second} >> 16)"


def uniform(seed: int, tag: str, key: str) -> str:
    return f"({draw(seed, tag, key)}::DOUBLE / 4294967296.0::DOUBLE)"


def randint(seed: int, tag: str, key: str, low: int, high: int) -> str:
    return f"((({draw(seed, tag, key)} * {high - low + 1}) >> 32) + {low})"


def quoted(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def choose(seed: int, tag: str, key: str, options: Sequence[object]) -> str:
    listed = ", ".join(quoted(o) for o in options)
    return f"([{listed}])[1 + {randint(seed, tag, key, 0, len(options) - 1)}]"


def weighted(seed: int, tag: str, key: str, options: Sequence[object], weights: Sequence[float]) -> str:
    total = float(sum(weights))
    point, reached, cases = uniform(seed, tag, key), 0.0, []
    for option, weight in zip(options[:-1], weights[:-1]):
        reached += weight
        cases.append(f"WHEN {point} < {reached / total!r}::DOUBLE THEN {quoted(option)}")
    return f"CASE {' '.join(cases)} ELSE {quoted(options[-1])} END"
