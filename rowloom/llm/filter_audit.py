"""Filter interaction audit: what each of five document filters removes alone, together and in every order.

Four filters look at a text alone. The fifth fails texts that a smaller id has too, table-wide:

1. every task enters the hashes of its texts into a counting Bloom filter; the sketches of all tasks are added up, and
   cells that were entered once clear the texts that have one of them: no other row has that text;
2. only rows that aren't cleared send their texts to a grouping by the *whole text*, which gives the least id. Rows with
   one text can't be told apart by its hash, so where all uncleared texts of a hash are the same, the hash names the text;
   rows of hashes that two texts share are matched by text.

The five flags make a mask of five bits. How many documents of a part have each mask, counted once, is enough for all 120
orders of the filters: the counts of an order are sums over masks.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import stored
from rowloom.plans.joins import lookup

FILTERS = "ABCDE"
MIN_LENGTH, MIN_DISTINCT, MAX_UPPER = 50, 65, 5
#: The sketch consists of blocks of so many cells; all cells of a text are in one block.
BLOCK = 1 << 13
CELLS_PER_ROW = 16
PROBES = 3
#: A sketch is broadcast up to this size: enough for 32 million rows; beyond it narrow rows travel to it.
SKETCH_BYTES = 64 << 20
#: Blocks are added up in groups of so many.
BLOCKS_AT_ONCE = 64
#: A task holds so many hashes before it sends their counts.
HELD = 2_000_000

WORDS = "filter(split({text}, '[ \\\\t-\\\\r]+'), w -> w != '')"


def own_flags(docs: DataFrame) -> DataFrame:
    """``doc_id, part, text, mask``: bits 0 to 3 tell which of the filters A to D the text fails."""
    read = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    read = read.withColumn("_w", F.expr(WORDS.format(text="text")))
    upper = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    fails = [
        F.size("_w") < MIN_LENGTH,
        100 * F.size(F.array_distinct("_w")).cast("bigint") < MIN_DISTINCT * F.size("_w").cast("bigint"),
        100 * upper.cast("bigint") > MAX_UPPER * F.length("text").cast("bigint"),
        F.col("text").rlike("[#$%&*|]"),
    ]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return read.select("doc_id", "part", "text", mask.cast("int").alias("mask"))


def places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash and its cells in it, one row per probe; the SQL form is ``probe``."""
    block = hashes.view(np.uint64) & np.uint64(blocks - 1)
    cells = [(hashes.view(np.uint64) >> np.uint64(64 - 13 * (k + 1))) & np.uint64(BLOCK - 1) for k in range(PROBES)]
    return block.astype(np.int64), np.stack(cells).astype(np.int64)


def sketches(blocks: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counting sketches of a task's hashes: which cells were entered, and whether more than once."""

    def counted(held: list[np.ndarray]) -> pd.DataFrame:
        every = np.concatenate(held)
        block, cells = places(every, blocks)
        # Two probes of a hash in one cell enter it once.
        cells = np.sort(cells, axis=0)
        there = np.ones(cells.shape, bool)
        there[1:] = cells[1:] != cells[:-1]
        keys, counts = np.unique((block * BLOCK + cells)[there], return_counts=True)
        group = keys // (BLOCK * BLOCKS_AT_ONCE)
        at, first = np.unique(group, return_index=True)
        spans = list(zip(first, np.append(first, len(keys))[1:], strict=True))
        return pd.DataFrame({
            "part": at,
            "cells": [(keys[a:b] % (BLOCK * BLOCKS_AT_ONCE)).astype("<u4").tobytes() for a, b in spans],
            "counts": [np.minimum(counts[a:b], 2).astype(np.uint8).tobytes() for a, b in spans],
        })

    held: list[np.ndarray] = []
    for batch in batches:
        held.append(batch["hash"].to_numpy(np.int64))
        if sum(map(len, held)) >= HELD:
            yield counted(held)
            held = []
    if held:
        yield counted(held)


def merged(sent: pd.DataFrame) -> pd.DataFrame:
    """The cells of a group of blocks that were entered twice or more, as bits of 128 numbers a block."""
    total = np.zeros(BLOCK * BLOCKS_AT_ONCE, np.uint8)
    for cells, counts in zip(sent["cells"], sent["counts"], strict=True):
        at = np.frombuffer(cells, "<u4")
        total[at] = np.minimum(total[at] + np.frombuffer(counts, np.uint8), 2)
    again = np.packbits(total.reshape(BLOCKS_AT_ONCE, BLOCK) == 2, axis=1, bitorder="little").view("<i8")
    block = int(sent["part"].iloc[0]) * BLOCKS_AT_ONCE + np.arange(BLOCKS_AT_ONCE)
    some = again.any(axis=1)
    return pd.DataFrame({"block": block[some], "bits": list(again[some])})


def probe(rows: DataFrame, sketch: DataFrame, blocks: int) -> DataFrame:
    """The rows whose hash may have been entered twice; ``hash`` must be a column.

    A sketch of up to SKETCH_BYTES is broadcast, a larger one joined.
    """
    rows = rows.withColumn("block", F.expr(f"hash & {blocks - 1}L"))
    small = blocks * BLOCK // 8 <= SKETCH_BYTES
    found = rows.join(F.broadcast(sketch), "block") if small else lookup(rows, sketch, ["block"], "inner")
    for k in range(PROBES):
        cell = f"(shiftrightunsigned(hash, {64 - 13 * (k + 1)}) & {BLOCK - 1})"
        found = found.filter(f"getbit(get(bits, CAST({cell} div 64 AS INT)), CAST({cell} % 64 AS INT)) = 1")
    return found.drop("block", "bits")


def repeat_sketch(hashes: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """The merged sketch of a column ``hash`` as a written table ``block, bits``, and its number of blocks."""
    blocks = 1 << (rows * CELLS_PER_ROW // BLOCK).bit_length()
    sent = hashes.mapInPandas(lambda batches: sketches(blocks, batches), "part bigint, cells binary, counts binary")
    return stored(sent.groupBy("part").applyInPandas(merged, "block bigint, bits array<bigint>"), "sketch"), blocks


def flag_documents(docs: DataFrame, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """A row per document: ``doc_id, part, mask``; bits 0 to 4 tell which of the filters A to E it fails.

    Null texts are empty texts, a null source is the part ``''``. A row fails E if a smaller id has the identical text;
    rows without an id neither fail it nor make others fail, and repeated rows of one id don't fail it because of
    each other. Other columns are ignored.
    """
    full = own_flags(docs).withColumn("hash", hash_of(F.col("text")))
    slim = stored(full.drop("text"), "flags")
    sketch, blocks = repeat_sketch(slim.select("hash"), slim.count())
    if blocks * BLOCK // 8 <= SKETCH_BYTES:
        possible = probe(full, sketch, blocks)
    else:
        # Texts can't be held against so large a sketch where they are; the narrow rows are.
        possible = full.join(probe(slim, sketch, blocks).select("hash").distinct(), "hash", "left_semi")
    known = possible.filter("doc_id IS NOT NULL").groupBy("hash", "text").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    per_hash = known.groupBy("hash").agg(
        F.min("first").alias("first"), F.count(F.lit(1)).alias("texts"), F.max(F.col("first") < F.col("last")).alias("again")
    )
    copies = stored(per_hash.filter("again").select("hash", "first", "texts"), "copies")
    shared = copies.filter("texts > 1").select("hash")
    rows = lookup(slim, copies.filter("texts = 1").select("hash", "first"), ["hash"])
    if shared.limit(1).count():
        # Different texts have one hash: these rows are matched by their whole text.
        mine = full.join(shared, "hash", "left_semi")
        least = mine.groupBy("text").agg(F.min("doc_id").alias("first"))
        by_text = mine.join(least, "text", "left")
        rows = rows.join(shared, "hash", "left_anti").unionByName(by_text.drop("text"))
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.select("doc_id", "part", (F.col("mask") + F.when(later, 1 << 4).otherwise(0)).cast("int").alias("mask"))


def orders() -> list[tuple[str, int, int, int]]:
    """All orders of the filters, step by step: ``order, step, bits of the filters before, bit of this filter``."""
    made = []
    for order in itertools.permutations(FILTERS):
        earlier = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            made.append(("".join(order), step, earlier, bit))
            earlier |= bit
    return made


def audit_filters(docs: DataFrame, labels: DataFrame, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """For each part, order of the filters and step: what is kept, removed, failed already, and lost of what labels mark.

    See ``flag_documents`` for nulls and repeated rows; each repeated row counts. A document is good or toxic if any of its
    labels says so; labels of null ids are ignored. An empty table gives no rows. Parts are counted apart at any
    number of them; ``shapley`` is what the filter removes, summed over all orders: of the documents that fail k
    filters each of these is the first in 120 / k orders.
    """
    spark = docs.sparkSession
    marked = labels.filter("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic")
    )
    rows = lookup(flag_documents(docs, hash_of), stored(marked, "marked"), ["doc_id"])
    masks = rows.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    steps = orders()
    asked = ", ".join(f"struct({earlier} AS earlier, {bit} AS bit)" for earlier, bit in sorted({s[2:] for s in steps}))
    each = masks.select("*", F.explode(F.expr(f"array({asked})")).alias("q")).select("*", "q.*")
    fails, before = "mask & bit != 0", "mask & earlier != 0"
    counted = each.groupBy("part", "earlier", "bit").agg(*[
        F.expr(f"coalesce(sum({what}) FILTER (WHERE {when}), 0L)").alias(name) for name, what, when in (
            ("kept", "n", f"NOT ({fails}) AND NOT ({before})"), ("removed", "n", f"{fails} AND NOT ({before})"),
            ("redundant", "n", f"{fails} AND {before}"), ("unique_fails", "n", "mask = bit"),
            ("good_lost", "good", f"{fails} AND NOT ({before})"), ("toxic_lost", "toxic", f"{fails} AND NOT ({before})"),
            ("shapley", "n * (120 div bit_count(mask))", fails),
        )
    ])
    turns = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, earlier int, bit int"))
    return counted.join(turns, ["earlier", "bit"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


#: For tables without null ids.
ORACLE = f"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split(translate(coalesce(text, ''),
    chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS w FROM documents),
f AS (
  SELECT doc_id, part,
    CAST(len(w) < {MIN_LENGTH} AS INT) + 2 * CAST(100 * len(list_distinct(w)) < {MIN_DISTINCT} * len(w) AS INT)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MAX_UPPER} * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(doc_id > min(doc_id) OVER (PARTITION BY t) AS INT) AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT f.part, f.mask, count(*) AS n, coalesce(sum(l.good), 0) AS good, coalesce(sum(l.toxic), 0) AS toxic
  FROM f LEFT JOIN l ON l.doc_id = f.doc_id GROUP BY f.part, f.mask),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS v),
o AS (
  SELECT [a.v, b.v, c.v, d.v, e.v] AS p FROM x a JOIN x b ON b.v <> a.v JOIN x c ON c.v NOT IN (a.v, b.v)
  JOIN x d ON d.v NOT IN (a.v, b.v, c.v) JOIN x e ON e.v NOT IN (a.v, b.v, c.v, d.v)),
s AS (
  SELECT array_to_string(list_transform(p, lambda v: substr('{FILTERS}', v, 1)), '') AS filter_order, k.v AS step,
    CAST(1 << (p[k.v] - 1) AS INT) AS bit, CAST(coalesce(list_sum(list_transform(p[1:k.v - 1], lambda v: 1 << (v - 1))), 0) AS INT) AS earlier FROM o, x k),
r AS (
  SELECT m.part, s.filter_order, s.step, s.bit,
    sum(n) FILTER (WHERE mask & bit = 0 AND mask & earlier = 0) AS kept,
    sum(n) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0) AS removed,
    sum(n) FILTER (WHERE mask & bit <> 0 AND mask & earlier <> 0) AS redundant,
    sum(n) FILTER (WHERE mask = bit) AS unique_fails,
    sum(good) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0) AS good_lost,
    sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0) AS toxic_lost
  FROM m, s GROUP BY m.part, s.filter_order, s.step, s.bit),
h AS (SELECT part, bit, sum(removed) AS shapley FROM r GROUP BY part, bit)
SELECT r.part, r.filter_order, CAST(r.step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(h.shapley, 0) AS BIGINT) AS shapley
FROM r JOIN h ON h.part = r.part AND h.bit = r.bit
"""
