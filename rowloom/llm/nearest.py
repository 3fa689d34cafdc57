"""Approximate nearest neighbours by inner product: randomly rotated one-bit codes with error bounds.

Vectors are dealt to the lists of a coarse quantiser. Of each one's residual to its list's centre the signs
after a random rotation are kept as packed bits, with its length and a correction scalar. They give an
unbiased estimate of the inner product with any query, and a bound on its error; only vectors whose
upper bound reaches the k-th best lower bound are scored exactly. Lists are searched in blocks of
bounded size, so a list that holds a third of all vectors is many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


NEIGHBOURS = 20
#: Vectors per list aimed at, and most lists: centres are broadcast.
LIST_ROWS, MOST_LISTS = 4_096, 4_096
#: Vectors the index is fitted on, at most about; and of those, queries on which the number of lists to search is set.
SAMPLE_ROWS, SAMPLE_QUERIES = 16_000, 300
#: Share of true neighbours within the searched lists of the sample.
TARGET = 0.97
BLOCK_VECTORS, BLOCK_QUERIES = 4_096, 1_024
#: Standard errors in the bound of an estimate.
BOUND = 2.5
SEED = 11


def usable(column: str) -> Column:
    """Vectors with components that are all finite and not all zero."""
    return F.expr(
        f"size(`{column}`) > 0 AND NOT exists(`{column}`, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
        f" AND exists(`{column}`, x -> x != 0)"
    )


@dataclass(frozen=True)
class Index:
    """Per dimension: centres, rotation and the least number of lists a query searches."""

    centres: dict[int, np.ndarray]
    rotation: dict[int, np.ndarray]
    probes: dict[int, int]

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        centres = self.centres[vectors.shape[1]]
        return (0.5 * (centres * centres).sum(axis=1) - vectors @ centres.T).argmin(axis=1)

    def searched(self, queries: np.ndarray, held: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the queries and the lists of each, most promising first: by inner product with their centres.

        Lists are added to the least number until those taken hold ``k`` rows besides the query's own; ``held`` are
        the rows of each list.
        """
        size = queries.shape[1]
        order = np.argsort(-(queries @ self.centres[size].T), axis=1, kind="stable")
        before = np.cumsum(held[order], axis=1) - held[order]
        taken = (np.arange(order.shape[1]) < self.probes[size]) | (before < k + 1)
        return np.nonzero(taken)[0], order[taken]

    def encode(self, vectors: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed sign bits of the rotated residuals, the residuals' lengths and the correction scalars."""
        size = vectors.shape[1]
        residual = vectors - self.centres[size][lists]
        length = np.linalg.norm(residual, axis=1)
        turned = residual @ self.rotation[size] / np.maximum(length, 1e-30)[:, None]
        return np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(axis=1) / math.sqrt(size)


def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def _centres(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from vectors drawn among the distinct ones."""
    distinct = np.unique(sample, axis=0)
    draw = np.random.default_rng(SEED)
    centres = distinct[draw.choice(len(distinct), min(lists, len(distinct)), replace=False)].copy()
    for _ in range(rounds):
        near = (0.5 * (centres * centres).sum(axis=1) - sample @ centres.T).argmin(axis=1)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def _probes(sample: np.ndarray, centres: np.ndarray, k: int, target: float) -> int:
    """The least number of lists that hold ``target`` of the sample queries' true neighbours in the sample."""
    draw = np.random.default_rng(SEED + 1)
    at = draw.choice(len(sample), min(SAMPLE_QUERIES, len(sample)), replace=False)
    scores = sample[at] @ sample.T
    scores[np.arange(len(at)), at] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centres)
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    home = (0.5 * (centres * centres).sum(axis=1) - sample @ centres.T).argmin(axis=1)
    order = np.argsort(-(sample[at] @ centres.T), axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    needed = np.sort(np.take_along_axis(rank, home[best], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, math.ceil(target * len(needed)))])


def fit_index(vectors: DataFrame, k: int = NEIGHBOURS, target: float = TARGET) -> Index:
    """Fit on about ``SAMPLE_ROWS`` rows of ``vec_id, embedding`` chosen by hash, separately per dimension."""
    sizes = {r[0]: r[1] for r in vectors.groupBy(F.size("embedding")).count().collect()}
    there = sum(sizes.values())
    cut = int(min(1.0, SAMPLE_ROWS / max(there, 1)) * (1 << 30))
    drawn = vectors.filter(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 30)) < cut).select("vec_id", "embedding").toPandas()
    drawn = drawn.sort_values("vec_id", kind="stable")["embedding"]
    centres, turns, probes = {}, {}, {}
    for size, rows in sizes.items():
        mine = [v for v in drawn if len(v) == size]
        sample = np.array(mine, np.float64) if mine else np.zeros((1, size))
        lists = max(1, min(MOST_LISTS, rows // LIST_ROWS, len(sample) // 8))
        centres[size], turns[size] = _centres(sample, lists), rotation(size)
        probes[size] = _probes(sample, centres[size], k, target)
    return Index(centres, turns, probes)


def _matrices(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows by dimension, with their vectors as a matrix."""
    for _, part in batch.groupby(batch["embedding"].map(len)):
        yield part, np.array(part["embedding"].tolist(), np.float64)


def search(
    vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, target: float = TARGET, index: Index | None = None
) -> DataFrame:
    """For each query row of ``vec_id, embedding`` its ``k`` nearest other rows: ``query_id, rank, vec_id, score``.

    The score is the inner product of the original vectors in double precision; ties go to the smaller
    id. Null ids and vectors that are null, empty, zero or not finite take no part. Rows that repeat an id count
    once, with the smallest vector where they differ. Vectors are compared within their dimension.
    A query whose lists hold fewer than ``k`` others searches further ones until they do, so fewer than ``k`` rows come
    back only where there are no more. How many rows each list holds is counted while the plan is built.
    """
    spark = vectors.sparkSession
    clean = (
        vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .filter(F.col("vec_id").isNotNull() & usable("embedding"))
        .groupBy("vec_id")
        .agg(F.min("embedding").alias("embedding"))
    )
    index = index or fit_index(clean, k, target)
    shared = spark.sparkContext.broadcast(index)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, matrix in _matrices(batch):
                lists = shared.value.assign(matrix)
                bits, length, correction = shared.value.encode(matrix, lists)
                yield pd.DataFrame({
                    "vec_id": part["vec_id"], "size": np.int32(matrix.shape[1]), "list": lists.astype(np.int32),
                    "code": [b.tobytes() for b in bits], "length": length, "correction": correction,
                    "vector": [v.tobytes() for v in matrix],
                })

    coded = clean.mapInPandas(
        deal, "vec_id bigint, size int, list int, code binary, length double, correction double, vector binary"
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, matrix in _matrices(batch):
                yield pd.DataFrame({"size": np.int32(matrix.shape[1]), "list": shared.value.assign(matrix).astype(np.int32)})

    # Lists are as many as the index has, so this table is small whatever the rows.
    counted = clean.select("embedding").mapInPandas(place, "size int, list int").groupBy("size", "list").agg(F.count(F.lit(1)).alias("rows")).toPandas()
    held = {size: np.zeros(len(centres), np.int64) for size, centres in index.centres.items()}
    for size, which, rows in counted.itertuples(index=False):
        held[size][which] = rows
    counts = spark.sparkContext.broadcast(held)

    def aim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, matrix in _matrices(batch):
                ids, size = part["vec_id"].to_numpy(), matrix.shape[1]
                for at in range(0, len(ids), BLOCK_QUERIES):
                    some = matrix[at : at + BLOCK_QUERIES]
                    rows, lists = shared.value.searched(some, counts.value[size], k)
                    packed = [v.tobytes() for v in some]
                    yield pd.DataFrame({
                        "vec_id": ids[at + rows], "size": np.int32(size), "list": lists.astype(np.int32), "vector": [packed[r] for r in rows],
                    })

    aimed = clean.filter(is_query).mapInPandas(aim, "vec_id bigint, size int, list int, vector binary")
    # How many blocks each list needs.
    held = spark.createDataFrame(counted.astype("int64").values.tolist(), "size int, list int, rows long")
    asked = aimed.groupBy("size", "list").agg(F.count(F.lit(1)).alias("asked"))
    blocks = held.join(asked, ["size", "list"]).select(
        "size", "list", F.ceil(F.col("rows") / BLOCK_VECTORS).alias("v_blocks"), F.ceil(F.col("asked") / BLOCK_QUERIES).alias("q_blocks")
    )
    blocks = F.broadcast(blocks)

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))

    def own(n: str, seed: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n)).cast("int")

    key = ["size", "list", "v_block", "q_block"]
    candidates = coded.join(blocks, ["size", "list"]).withColumn("v_block", own("v_blocks", 1)).withColumn("q_block", every("q_blocks"))
    queries = aimed.join(blocks, ["size", "list"]).withColumn("q_block", own("q_blocks", 2)).withColumn("v_block", every("v_blocks"))

    def meet(group: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _search_block(shared.value, int(group[0]), int(group[1]), left, right, k)

    found = (
        candidates.select(*key, "vec_id", "code", "length", "correction", "vector").groupBy(*key)
        .cogroup(queries.select(*key, "vec_id", "vector").groupBy(*key))
        .applyInPandas(meet, "query_id bigint, vec_id bigint, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_block(index: Index, size: int, which: int, vectors: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best vectors of a block for each query of a block, by bounds first and exactly then."""
    if vectors.empty or queries.empty:
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    ids, asked = vectors["vec_id"].to_numpy(np.int64), queries["vec_id"].to_numpy(np.int64)
    x, q = (np.frombuffer(b"".join(t["vector"])).reshape(-1, size) for t in (vectors, queries))
    packed = np.frombuffer(b"".join(vectors["code"]), np.uint8).reshape(len(ids), -1)
    signs = np.unpackbits(packed, axis=1, count=size).astype(np.float32) * 2 - 1
    length, correction = vectors["length"].to_numpy(), np.maximum(vectors["correction"].to_numpy(), 1e-12)
    turned = (q @ index.rotation[size]).astype(np.float32)
    guess = (turned @ signs.T) * (length / correction / math.sqrt(size)) + (q @ index.centres[size][which])[:, None]
    spread = length * np.sqrt(np.maximum(1 / correction**2 - 1, 0)) / math.sqrt(max(size - 1, 1))
    error = BOUND * np.linalg.norm(q, axis=1)[:, None] * spread
    own = asked[:, None] == ids
    low, high = np.where(own, -np.inf, guess - error), np.where(own, -np.inf, guess + error)
    near = min(k, len(ids)) - 1
    least = -np.partition(-low, near, axis=1)[:, near]
    out = []
    for i, query in enumerate(asked):
        at = np.flatnonzero((high[i] >= least[i]) & ~own[i])
        exact = x[at] @ q[i]
        if len(at) > k:
            edge = -np.partition(-exact, k - 1)[k - 1]
            keep = exact >= edge
            at, exact = at[keep], exact[keep]
        order = np.lexsort((ids[at], -exact))[:k]
        out.append(pd.DataFrame({"query_id": query, "vec_id": ids[at][order], "score": exact[order]}))
    return pd.concat(out, ignore_index=True)
