"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

The lexicon holds whole words and word beginnings whose document frequencies differ between the
labelled classes, weighted by their log odds. Exception phrases are word pairs around an entry that clean
documents hold more often than toxic ones. Folding undoes look-alike letters and digits. A logistic curve
over length-normalised features turns matches into a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Container, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import held_out, labelled_sample, labelled_texts

# Look-alikes of Latin letters in the Cyrillic and Greek alphabets, and digits used as letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ғ": "f", "ɡ": "g", "һ": "h", "і": "i", "ј": "j", "к": "k",
    "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w",
    "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ſ": "s",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}
STEM_LENGTHS = (4, 5)
#: Labelled documents to learn from, at most about this many.
LABEL_ROWS = 200_000
FLUSH_CANDIDATES = 400_000
THRESHOLD = 0.5

_fold_table = str.maketrans(HOMOGLYPHS | DIGITS)
_signs = re.compile(r"(?<=[^\W\d_])[@$!|](?=[^\W\d_])")
_between = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Lower case, look-alikes and digits as letters, anything else one blank; a blank at both ends.

    ``@ $ ! |`` are letters only between two letters.
    """
    folded = text.lower().translate(_fold_table)
    folded = _signs.sub(lambda m: SIGNS[m[0]], folded)
    return f" {_between.sub(' ', folded).strip()} "


def candidates(folded: str) -> set[str]:
    """Words of a folded text as ``' word '`` and their beginnings as ``' word'``."""
    words = set(folded.split())
    found = {f" {w} " for w in words}
    for length in STEM_LENGTHS:
        found.update(f" {w[:length]}" for w in words if len(w) > length)
    return found


def count_by_class(found_in: Callable[[str], set[str]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function for ``mapInPandas``: partial document frequencies per class of what is found in a folded text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = (Counter(), Counter())

        def flush() -> Iterator[pd.DataFrame]:
            for label, counter in enumerate(held):
                yield pd.DataFrame({
                    "entry": pd.Series(list(counter), dtype=object), "toxic": np.int32(label),
                    "n": np.fromiter(counter.values(), np.int64, len(counter)),
                })
                counter.clear()

        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                held[label].update(found_in(fold(text)))
                if len(held[0]) + len(held[1]) > FLUSH_CANDIDATES:
                    yield from flush()
        yield from flush()

    return count


def pairs_around(folded: str, lexicon: Container[str]) -> set[str]:
    """Pairs of neighbouring words of which at least one holds an entry, as ``' word word '``."""
    words = folded.split()
    listed = [
        f" {w} " in lexicon or any(f" {w[:k]}" in lexicon for k in STEM_LENGTHS if len(w) > k) for w in words
    ]
    return {f" {words[i]} {words[i + 1]} " for i in range(len(words) - 1) if listed[i] or listed[i + 1]}


def class_counts(rows: DataFrame, found_in: Callable[[str], set[str]]) -> DataFrame:
    """``entry, a, b``: how many toxic and how many clean documents hold the entry."""
    return (
        rows.mapInPandas(count_by_class(found_in), "entry string, toxic int, n bigint")
        .groupBy("entry")
        .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"),
             F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    )


@dataclass(frozen=True)
class ToxicityModel:
    """Lexicon entries with weights, exception phrases, and the coefficients of the logistic curve."""

    lexicon: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, ...]

    @cached_property
    def automaton(self) -> ahocorasick.Automaton | None:
        """Value of an entry: its length and weight, negative length for an exception phrase."""
        made = ahocorasick.Automaton()
        for entry, weight in self.lexicon.items():
            made.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            folded = fold(phrase)
            made.add_word(folded, (-len(folded), 0.0))
        if len(made):
            made.make_automaton()
        return made if len(made) else None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """Weight of all hits, hits, weight by the square root of the number of words, log of that number.

        Where entries overlap in one word only the heaviest counts; hits inside an exception phrase don't.
        """
        folded = fold(text or "")
        words = folded.count(" ") - 1
        if words < 1 or not folded.strip() or self.automaton is None:
            return 0.0, 0.0, 0.0, 0.0
        best: dict[int, float] = {}
        exempt: list[tuple[int, int]] = []
        for end, (length, weight) in self.automaton.iter(folded):
            if length < 0:
                exempt.append((end + length + 1, end))
            else:
                start = end - length + 1
                best[start] = max(best.get(start, 0.0), weight)
        if exempt:
            covered = {i for a, b in exempt for i in range(a, b)}
            best = {start: weight for start, weight in best.items() if start not in covered}
        weight = sum(best.values())
        return weight, float(len(best)), weight / words**0.5, float(np.log1p(words))

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        if not self.curve:
            return np.zeros(len(texts))
        x = _design(np.array([self.features(t) for t in texts]).reshape(-1, 4))
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.curve), -40, 40)))


def _design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.log1p(x[:, 0]), np.sqrt(x[:, 1]), x[:, 2], x[:, 3]])


def fit_curve(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge."""
    x, beta = _design(features), np.zeros(5)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        gradient = x.T @ (p - labels) + ridge * beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(5), gradient)
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, folds: int = 5, fold_out: int = 0, bound: int = LABEL_ROWS,
    min_docs: int = 3, min_log_odds: float = 3.0, exceptions: Sequence[str] = (), exception_log_odds: float = 1.0,
) -> ToxicityModel:
    """Learn lexicon, exception phrases and curve from about ``bound`` labelled documents outside the held-out fold.

    An entry needs ``min_docs`` toxic documents and ``min_log_odds``; an exception phrase ``min_docs`` clean
    documents and ``exception_log_odds`` for clean. ``exceptions`` adds phrases. An id with several
    texts teaches by the least of them. Without toxic and clean documents to learn from, every score is 0.
    """
    spark = docs.sparkSession
    rows = labelled_texts(docs, labelled_sample(labels, "toxic", folds, fold_out, bound)).select("text", "label")
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return ToxicityModel({}, tuple(exceptions), ())
    log_odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (clean + 1))
    entries = (
        class_counts(rows, candidates)
        .select("entry", "a", log_odds.alias("weight"))
        .filter((F.col("a") >= min_docs) & (F.col("weight") >= min_log_odds))
        .toPandas()
    )
    lexicon = dict(zip(entries["entry"], entries["weight"].tolist(), strict=True))
    listed = spark.sparkContext.broadcast(frozenset(lexicon))
    harmless = (
        class_counts(rows, lambda folded: pairs_around(folded, listed.value))
        .filter((F.col("b") >= min_docs) & (log_odds <= -exception_log_odds))
        .select("entry")
        .toPandas()
    )
    phrases = (*exceptions, *sorted(harmless["entry"]))
    shared = spark.sparkContext.broadcast(ToxicityModel(lexicon, phrases, ()))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shared.value.features(t) for t in batch["text"]]
            yield pd.DataFrame(found, columns=["w", "hits", "dense", "size"]).assign(label=batch["label"].to_numpy())

    known = rows.mapInPandas(measure, "w double, hits double, dense double, size double, label int").toPandas()
    curve = fit_curve(known[["w", "hits", "dense", "size"]].to_numpy(), known["label"].to_numpy(float))
    return ToxicityModel(lexicon, phrases, tuple(curve.tolist()))


def toxicity_score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> Column:
    """A column with the probability that the text is toxic; null and empty texts score as texts without a hit."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score([t if isinstance(t, str) else None for t in texts]))

    return score(docs[text].cast("string"))


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, fold_out: int = 0) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted`` (1 from a score of 0.5).

    Null and empty texts have no hit and get the score of such texts; null ids are scored, not learned
    from; contradicting labels of one id are left out; repeated rows each get their row; no usable
    labels: score 0; other columns are ignored.
    """
    model = fit_toxicity(docs, labels, folds, fold_out)
    scored = docs.select(
        "doc_id", held_out(F.col("doc_id"), folds, fold_out).alias("held_out"), toxicity_score(docs, model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score stays below the threshold, with all their columns.

    Null and empty texts score as texts without a hit; null ids are judged but teach nothing; repeated rows are
    judged alike; an empty table stays empty; without usable labels every document stays.
    """
    model = fit_toxicity(docs, labels)
    return docs.filter(toxicity_score(docs, model) < threshold)
