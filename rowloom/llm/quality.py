"""Quality classifier: random-indexing word vectors, pooled per document, and a small neural network.

Each word (hashed to a bucket) has a sparse random index vector; its word vector sums the index vectors of
its neighbours over the whole corpus. Partial sums per task hold one vector per bucket at most, so
neither the shuffle per task nor the broadcast grows with the number of documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import held_out, labelled_sample, pieces

BUCKETS = 1 << 13
DIM = 32
NONZERO = 4
WINDOW = 2
HIDDEN = 24
CHUNK_CHARS = 1 << 21
CACHE_WORDS = 300_000
#: Labelled documents to learn from, at most about this many.
LABEL_ROWS = 60_000
THRESHOLD = 0.7

_upper, _digit = re.compile(r"[^\W\d_]{2,}"), re.compile(r"\d+")
_cache: dict[str, int] = {}


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket: the places of its non-zero entries and their signs."""
    draw = np.random.default_rng(20240501)
    places = np.argsort(draw.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    return places.astype(np.int64), draw.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


def normal_form(word: str) -> str:
    """A plain word as it is in lower case; of others, whose letters tell less than their form, that form."""
    if word.isalpha() and not word[1:].isupper():
        return word.lower()
    core = word.rstrip(".,;:")
    if core.isalpha() and not core[1:].isupper():
        return core.lower()
    return _digit.sub("0", _upper.sub(lambda m: "A" if m[0].isupper() else "a", word))


def token_ids(text: str) -> np.ndarray:
    """Buckets of a text's words. A word that repeats the one before counts as the mark of repetition (bucket 0)."""
    if len(_cache) > CACHE_WORDS:
        _cache.clear()
    known = _cache
    words = text.split()
    ids = [known.get(w, -1) for w in words]
    for i, found in enumerate(ids):
        if found < 0:
            w = words[i]
            ids[i] = known[w] = 1 + zlib.crc32(normal_form(w).encode("utf-8", "surrogatepass")) % (BUCKETS - 1)
    made = np.array(ids, np.int64)
    made[1:][made[1:] == made[:-1]] = 0
    return made


def sum_contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the buckets this task met: the sum of their neighbours' index vectors."""
    places, signs = index_vectors()
    total = np.zeros(BUCKETS * DIM)
    met = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        texts = [t for t in batch["text"] if isinstance(t, str)]
        for piece in pieces(texts, CHUNK_CHARS):
            parts = [token_ids(text) for _, text in piece]
            gap = np.full(WINDOW, -1, np.int64)
            ids = np.concatenate([x for p in parts for x in (p, gap)])
            met += np.bincount(ids[ids >= 0], minlength=BUCKETS)
            for off in range(1, WINDOW + 1):
                left, right = ids[:-off], ids[off:]
                both = (left >= 0) & (right >= 0)
                left, right = left[both], right[both]
                for k in range(NONZERO):
                    total += np.bincount(left * DIM + places[right, k], signs[right, k], BUCKETS * DIM)
                    total += np.bincount(right * DIM + places[left, k], signs[left, k], BUCKETS * DIM)
    at = np.flatnonzero(met)
    made = pd.DataFrame(total.reshape(BUCKETS, DIM)[at], columns=[f"d{i}" for i in range(DIM)])
    made.insert(0, "bucket", at.astype(np.int32))
    yield made


@dataclass(frozen=True)
class QualityModel:
    """Word vectors, the network's layers, its input scaling and its temperature."""

    vectors: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float

    def pooled(self, texts: Sequence[str | None]) -> np.ndarray:
        """Per text: mean and spread of its word vectors, and the share of the repetition mark. Zeros without words."""
        n = len(texts)
        first, second, count, again = np.zeros((n, DIM)), np.zeros((n, DIM)), np.zeros(n), np.zeros(n)
        for piece in pieces([t or "" for t in texts], CHUNK_CHARS):
            for i, text in piece:
                ids = token_ids(text)
                if len(ids):
                    seen = np.bincount(ids, minlength=1)
                    at = np.flatnonzero(seen)
                    part, weight = self.vectors[at], seen[at][:, None]
                    first[i] += (part * weight).sum(axis=0)
                    second[i] += (part * part * weight).sum(axis=0)
                    count[i] += len(ids)
                    again[i] += seen[0]
        some = np.maximum(count, 1)[:, None]
        mean = first / some
        spread = np.sqrt(np.maximum(second / some - mean * mean, 0))
        return np.hstack([mean, spread, again[:, None] / some, np.log1p(count)[:, None]])

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        if not self.layers:
            return np.full(len(texts), 0.5)
        x = (self.pooled(texts) - self.centre) / self.spread
        return 1 / (1 + np.exp(-np.clip(forward(self.layers, x)[1] / self.temperature, -40, 40)))


def forward(layers: Sequence[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.tanh(x @ w1 + b1)
    return hidden, hidden @ w2 + b2[0]


def train_network(x: np.ndarray, y: np.ndarray, rounds: int = 60, batch: int = 256, seed: int = 3) -> tuple[np.ndarray, ...]:
    """Two layers trained by Adam on log loss with a little weight decay."""
    draw = np.random.default_rng(seed)
    layers = [
        draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1),
    ]
    slow, fast, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    rounds = max(3, min(rounds, 3_000_000 // max(len(x), 1)))
    for turn in range(rounds):
        order = draw.permutation(len(x))
        rate = 5e-3 * (1 - turn / rounds) + 1e-4
        for start in range(0, len(x), batch):
            at = order[start : start + batch]
            hidden, logit = forward(layers, x[at])
            error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y[at]) / len(at)
            back = np.outer(error, layers[2]) * (1 - hidden**2)
            gradients = [x[at].T @ back + 1e-4 * layers[0], back.sum(axis=0), hidden.T @ error + 1e-4 * layers[2], error.sum(keepdims=True)]
            step += 1
            for i, g in enumerate(gradients):
                slow[i] = 0.9 * slow[i] + 0.1 * g
                fast[i] = 0.999 * fast[i] + 0.001 * g * g
                layers[i] = layers[i] - rate * (slow[i] / (1 - 0.9**step)) / (np.sqrt(fast[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(layers)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss on rows the network wasn't trained on."""
    best = (np.inf, 1.0)
    for t in np.geomspace(0.25, 8, 60):
        p = np.clip(1 / (1 + np.exp(-np.clip(logits / t, -40, 40))), 1e-9, 1 - 1e-9)
        best = min(best, (float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()), float(t)))
    return best[1]


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Vectors of all buckets from every document: own index vector plus the mean direction of the contexts."""
    columns = [f"d{i}" for i in range(DIM)]
    summed = (
        docs.select(F.col("text").cast("string").alias("text"))
        .mapInPandas(sum_contexts, "bucket int, " + ", ".join(f"{c} double" for c in columns))
        .groupBy("bucket")
        .agg(*[F.sum(c).alias(c) for c in columns])
        .toPandas()
    )
    places, signs = index_vectors()
    made = np.zeros((BUCKETS, DIM))
    np.put_along_axis(made, places, signs / NONZERO**0.5, axis=1)
    if len(summed):
        context = summed[columns].to_numpy()
        made[summed["bucket"].to_numpy()] += context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    return made / np.linalg.norm(made, axis=1, keepdims=True)


def fit_quality(
    docs: DataFrame, labels: DataFrame, folds: int = 4, fold_out: int = 2, bound: int = LABEL_ROWS
) -> QualityModel:
    """Word vectors from all texts; the network from about ``bound`` labelled documents outside the held-out fold.

    A fifth of those, chosen by their order, sets the temperature. Without both classes every score is 0.5.
    """
    spark = docs.sparkSession
    model = QualityModel(word_vectors(docs), np.zeros(1), np.ones(1), (), 1.0)
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = shared.value.pooled([t if isinstance(t, str) else None for t in batch["text"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "x": list(x.astype(np.float32))})

    chosen = labelled_sample(labels, "quality", folds, fold_out, bound)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = (
        rows.join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "text", "label")
        .mapInPandas(measure, "doc_id bigint, label int, x array<float>")
        .toPandas()
        .sort_values("doc_id", kind="stable")
    )
    if known["label"].nunique() < 2:
        return model
    x, y = np.vstack(known["x"].to_numpy()).astype(float), known["label"].to_numpy(float)
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - centre) / spread
    aside = np.arange(len(x)) % 5 == 4
    layers = train_network(x[~aside], y[~aside])
    temperature = calibrate(forward(layers, x[aside])[1], y[aside]) if aside.any() else 1.0
    return QualityModel(model.vectors, centre, spread, layers, temperature)


def quality_score(docs: DataFrame, model: QualityModel, text: str = "text") -> Column:
    """A column with the probability of good quality; null and empty texts are scored as texts without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score([t if isinstance(t, str) else None for t in texts]))

    return score(docs[text].cast("string"))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, fold_out: int = 2) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted`` (1 from a score of 0.7).

    Null and empty texts score as texts without words; null ids are scored, not learned from; contradicting
    labels of one id are left out; repeated rows each get their row; no usable labels: score 0.5;
    other columns are ignored.
    """
    model = fit_quality(docs, labels, folds, fold_out)
    scored = docs.select(
        "doc_id", held_out(F.col("doc_id"), folds, fold_out).alias("held_out"), quality_score(docs, model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
