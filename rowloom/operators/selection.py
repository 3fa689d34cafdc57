"""Which rows a degrading operator touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions import rng

SLOT_BITS = 16


def share_of_rows(ratio: float, seed: int, tag: str, key: str) -> Column:
    """True for about ``ratio`` of the rows; no pass over the data, works on streams."""
    return rng.below(ratio, seed, tag, key)


def exact_share(
    df: DataFrame, ratio: float, seed: int, tag: str, key: str, at_least: int = 1, at_most: int | None = None
) -> Column:
    """True for exactly ``max(at_least, floor(rows * ratio))`` rows of ``df``, or for
    ``at_most`` rows where that is less.

    Rows are ranked by their draw and the cut-off draw is found from two small
    histograms over the key column, at most 65,536 groups each. The result is a
    plain predicate, so the data itself is neither sorted nor shuffled.
    Keys must be unique.
    """
    hashed = df.select(F.expr(key).cast("bigint").alias("key")).select("key", rng.draw(seed, tag, "key").alias("h"))
    slot = F.shiftright("h", SLOT_BITS)
    wanted = F.greatest(F.lit(at_least), F.floor(F.sum("n").over(_everything()) * F.lit(float(ratio))))
    if at_most is not None:
        wanted = F.least(wanted, F.lit(at_most))
    if ratio >= 1 and at_most is None:
        return F.lit(True)
    first = _cut(hashed.groupBy(slot.alias("at")).agg(F.count(F.lit(1)).alias("n")), wanted)
    draws = rng.draw(seed, tag, key)
    if first is None:
        return F.lit(False)
    inside = hashed.filter(slot == first["at"])
    cut = _cut(inside.groupBy(F.col("h").alias("at")).agg(F.count(F.lit(1)).alias("n")), F.lit(first["short"]))
    if cut["short"] == cut["n"]:
        return draws <= F.lit(cut["at"])
    # Only about rows / 2**32 keys can share one draw.
    last = (
        hashed.filter(F.col("h") == cut["at"]).select("key").orderBy("key").limit(cut["short"]).agg(F.max("key"))
    ).first()[0]
    return (draws < F.lit(cut["at"])) | ((draws == F.lit(cut["at"])) & (F.expr(key) <= F.lit(last)))


def _everything() -> Window:
    return Window.partitionBy()


def _cut(histogram: DataFrame, wanted: Column):
    """The histogram row where the running total first reaches the wanted count."""
    running = Window.orderBy("at")
    return (
        histogram.withColumn("wanted", wanted)
        .withColumn("reached", F.sum("n").over(running))
        .filter((F.col("reached") >= F.col("wanted")) & (F.col("reached") - F.col("n") < F.col("wanted")))
        .select("at", "n", (F.col("wanted") - (F.col("reached") - F.col("n"))).alias("short"))
        .first()
    )


def head_sample(df: DataFrame, order: str, limit: int) -> DataFrame:
    """The first ``limit`` rows and whether there were more; only ``limit + 1`` rows are ranked."""
    some = df.orderBy(order).limit(limit + 1)
    ranked = some.withColumns(
        {
            "_rank": F.row_number().over(Window.orderBy(order)),
            "truncated": F.count(F.lit(1)).over(_everything()) > limit,
        }
    )
    return ranked.filter(F.col("_rank") <= limit).drop("_rank")
