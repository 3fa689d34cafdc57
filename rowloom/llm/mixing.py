"""Mixing sources to target weights by Poisson replication, in DataFrame expressions only.

Each source gets a mean repetition rate: target share x rows wanted / rows it has. A document's number of
copies is its rate's Poisson distribution inverted at a number hashed from seed and id, so a lost task
makes the same copies again. Copies are spread over all partitions and ordered there by a second hash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import fresh

SEED = 20240607
#: Distribution steps of all sources together up to which their table is broadcast (16 MB of doubles).
BROADCAST_STEPS = 2_000_000
SALTS = 64
HASH_BITS = 52
#: Above this rate the distribution starts near its mean, where its first step is no longer 0 in a double.
FAR_RATE = 200


def hashed(*parts: Column | str) -> Column:
    """A whole number below 2**52 hashed from text parts; any engine with MD5 gets the same."""
    joined = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def row_key(docs: DataFrame) -> Column:
    """The id as text; of a row without one, its text's digest."""
    digest = F.concat(F.lit("t"), F.md5(F.coalesce(docs["text"].cast("string"), F.lit(""))))
    return F.coalesce(docs["doc_id"].cast("string"), digest)


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None, rows: float | None) -> DataFrame:
    """``source, rate`` of every source in the table; rows without a source are a source of their own.

    Without weights all sources weigh the same; a source missing in them weighs 0. Weights are scaled so that
    those of the sources in the table make 1.
    """
    counts = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    counts = counts.withColumn("weight", weight)
    all_rows, all_weight = counts.agg(F.sum("n"), F.sum("weight")).first()
    wanted = float(all_rows or 0) if rows is None else float(rows)
    scale = wanted / all_weight if all_weight else 0.0
    return counts.select("source", (F.lit(scale) * F.col("weight") / F.col("n")).alias("rate"))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """Adds ``least``, the smallest count considered, and ``steps``: P(count <= least), P(count <= least + 1), ...

    The steps cover twelve standard deviations each way; beyond them a double holds nothing.
    """
    return rates.selectExpr(
        "source", "rate",
        f"CASE WHEN rate > {FAR_RATE} THEN CAST(floor(rate - 12 * sqrt(rate) - 20) AS BIGINT) ELSE 0L END AS least",
        "CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT) AS most",
    ).selectExpr(
        "source", "rate", "least", "most - least + 1 AS n_steps",
        "CASE WHEN least = 0 THEN exp(-rate) ELSE exp(least * ln(rate) - rate - (least * ln(least) - least"
        " + 0.5 * ln(2 * pi() * least) + 1 / (12 * least) - 1 / (360 * power(least, 3)))) END AS first",
        "most",
    ).selectExpr(
        "source", "rate", "least", "n_steps",
        "aggregate(sequence(least + 1, most), named_struct('p', first, 'c', array(first)), (s, k) -> "
        "named_struct('p', s.p * rate / k, 'c', array_append(s.c, element_at(s.c, -1) + s.p * rate / k)), s -> s.c) AS steps",
    )


def mix_sources(
    docs: DataFrame, weights: Mapping[str, float] | None = None, rows: float | None = None, seed: int = SEED
) -> DataFrame:
    """Documents repeated to the target weights, all columns kept, plus ``copy`` (from 1) and ``mix_order``.

    ``rows`` is the expected number of rows, by default that of the table. Every partition of the result holds
    a uniform draw of all copies in the order of ``mix_order``. Defined cases: a null source is a source of its own;
    a null id is replaced by the text's digest in hashes, so texts without id repeat alike; repeated rows get
    the same number of copies each; null and empty texts are rows like others; an empty table gives an
    empty result. Where ``copy`` or ``mix_order`` is taken the new column gets a leading underscore.
    """
    rates = source_rates(docs, weights, rows).filter("rate > 0")
    mapped = poisson_steps(rates).withColumnsRenamed({c: f"_mix_{c}" for c in ("source", "rate", "least", "n_steps", "steps")})
    names = docs.columns
    copy, order = fresh(names, "copy"), fresh(names, "mix_order")
    key = fresh(names, "_mix_key")
    keyed = docs.withColumn(key, row_key(docs))
    same = F.col("source").cast("string").eqNullSafe(F.col("_mix_source"))
    if (mapped.agg(F.sum("_mix_n_steps")).first()[0] or 0) <= BROADCAST_STEPS:
        joined = keyed.join(F.broadcast(mapped), same)
    else:
        salt = F.pmod(F.xxhash64(key), F.lit(SALTS))
        salted = mapped.withColumn("_mix_salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
        joined = keyed.join(salted, same & (salt == F.col("_mix_salt"))).drop("_mix_salt")
    uniform = hashed(str(seed), "count", F.col(key)) / F.lit(float(1 << HASH_BITS))
    repeated = joined.withColumn("_mix_u", uniform).withColumn(
        "_mix_copies", F.expr("_mix_least + size(filter(_mix_steps, x -> x <= _mix_u))")
    )
    copies = repeated.filter("_mix_copies > 0").select(
        *[F.col(f"`{c}`") for c in names], key, F.explode(F.expr("sequence(1L, _mix_copies)")).alias(copy)
    )
    placed = copies.withColumn(order, hashed(str(seed), "order", F.col(key), F.col(copy).cast("string"))).drop(key)
    return placed.repartition(F.col(order)).sortWithinPartitions(order)


ORACLE = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT CAST(sum(n) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS scale FROM n),
r AS (SELECT source, scale * 1.0 / n AS rate FROM n, t),
c(source, rate, k, p, cdf) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM c
  WHERE k < CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT)),
u AS (
  SELECT d.*, CAST('0x' || substr(md5('{SEED}|count|' || d.doc_id), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM documents d),
s AS (SELECT source, list(cdf ORDER BY k) AS steps FROM c GROUP BY source),
m AS (SELECT u.*, len(list_filter(steps, lambda x: x <= u.u)) AS copies FROM u JOIN s ON u.source IS NOT DISTINCT FROM s.source),
e AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1)) AS copy FROM m)
SELECT doc_id, text, lang, source, n_chars, copy,
  CAST('0x' || substr(md5('{SEED}|order|' || doc_id || '|' || copy), 1, 13) AS BIGINT) AS mix_order FROM e
"""
