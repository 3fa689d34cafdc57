"""Distributions laid over a generated base value."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions import rng
from rowloom.plans.spec import Shape

NUMBER = ("integer", "bigint", "float", "decimal", "currency", "percent")
WHOLE = ("integer", "bigint")


def floor_to(value: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(value * scale) / F.lit(scale)


def half_up(value: Column, digits: int = 0) -> Column:
    """Round half up; unlike ``round`` it has no engine-specific tie handling."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / F.lit(scale)


def gaussian(seed: int, tag: str, key: str) -> Column:
    """Standard normal by the Box-Muller transform of two independent draws."""
    radius = (rng.draw(seed, tag + ".radius", key) + 1) / F.lit(float(rng.TWO32))
    angle = rng.uniform(seed, tag + ".angle", key)
    return F.sqrt(F.lit(-2.0) * F.log(radius)) * F.cos(F.lit(2.0 * math.pi) * angle)


def apply_shape(base: Column, kind: str, shape: Shape, seed: int, tag: str, key: str) -> Column:
    """The shaped value; ``kind`` is the logical type of the base column."""
    params = shape.params
    name = shape.kind.lower()
    numeric = kind in NUMBER
    whole = kind in WHOLE

    if name in ("normal", "gaussian"):
        if not numeric:
            return base
        value = F.lit(float(params.get("mu", 0))) + F.lit(float(params.get("sigma", 1))) * gaussian(seed, tag, key)
        return half_up(value).cast("bigint") if whole else half_up(value, 4)

    if name in ("skewed", "lognormal"):
        value = F.exp(
            F.lit(float(params.get("mu", 0))) + F.lit(float(params.get("sigma", 1))) * gaussian(seed, tag, key)
        )
        return half_up(value).cast("bigint") if whole else half_up(value, 4)

    if name == "categorical":
        categories = params.get("categories") or []
        if not categories:
            return base
        return rng.choose_weighted(seed, tag, key, categories, params.get("weights"))

    if name == "seasonal" and numeric:
        away = rng.uniform(seed, tag, key) - F.lit(float(params.get("phase", 0.25)))
        lift = F.lit(float(params.get("amplitude", 1.5)) - 1.0) * F.exp(F.lit(-20.0) * away * away)
        return _like(base.cast("double") * (F.lit(1.0) + lift), whole)

    if name == "long_tail" and numeric:
        number = base.cast("double")
        size = rng.uniform(seed, tag + ".size", key)
        head = F.coalesce(number, F.lit(0.0)) * F.lit(float(params.get("head_scale", 1.0))) * size
        filled = F.when(F.coalesce(number, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(number)
        tail = filled * F.lit(float(params.get("tail_scale", 10.0))) * (F.lit(1.0) + size)
        in_head = rng.below(params.get("head_ratio", 0.9), seed, tag + ".part", key)
        return _like(F.when(in_head, head).otherwise(tail), whole)

    return base


def _like(value: Column, whole: bool) -> Column:
    return value.cast("bigint") if whole else value
