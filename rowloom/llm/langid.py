"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting runs where the documents are: each task keeps one dense count vector per language and
emits its non-zero entries. What reaches the driver is one count per language and hash bucket,
whatever the number of documents. Scoring looks n-grams up in the broadcast log-probability matrix,
or in one matrix after the other where there are very many languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import fresh, held_out, learnable, pieces, stored

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
CHUNK_CHARS = 1 << 20
FLUSH_LANGUAGES = 64
#: Languages of one model (64 MB). It is broadcast; more languages make more models and a pass for each.
MODEL_LANGS = 512
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether a code point is a letter, as a lookup table."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def gram_buckets(parts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1-, 2- and 3-grams: the bucket at each character (``BUCKETS`` where there is none), and the parts' starts.

    Texts are lower-cased and all but letters become a blank. The n-grams are those of each word with
    a blank before and after it, so they never span two words or two texts.
    """
    lowered = [f" {p.lower()} " for p in parts]
    starts = np.concatenate(([0], np.cumsum([len(p) for p in lowered])[:-1])).astype(np.int64)
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    real = letters()[code]
    code = np.where(real, code, np.uint32(32))
    shift = np.uint32(32 - BUCKET_BITS)
    for order in (1, 2, 3):
        if order == 1:
            mixed, valid = code * np.uint32(0x9E3779B1), real
        elif order == 2:
            mixed, valid = code * np.uint32(0x85EBCA6B), real.copy()
            mixed[:-1] += code[1:] * np.uint32(0xC2B2AE35)
            valid[:-1] |= real[1:]
            valid[-1] = False
        else:
            mixed, valid = code * np.uint32(0x27D4EB2F), np.zeros(len(code), bool)
            mixed[:-2] += code[1:-1] * np.uint32(0x165667B1) + code[2:] * np.uint32(0xB5297A4D)
            valid[:-2] = real[1:-1]
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        yield np.where(valid, mixed >> shift, np.uint32(BUCKETS)), starts


def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts per language and bucket; bucket -1 counts documents."""
    held: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pd.DataFrame]:
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": (at - 1).astype(np.int32), "n": counts[at]})
        held.clear()

    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            if lang not in held:
                if len(held) >= FLUSH_LANGUAGES:
                    yield from flush()
                held[lang] = np.zeros(BUCKETS + 2, np.int64)
            held[lang][0] += len(texts)
            for piece in pieces(texts.tolist(), CHUNK_CHARS):
                for buckets, _ in gram_buckets([text for _, text in piece]):
                    held[lang][1:] += np.bincount(buckets, minlength=BUCKETS + 1)
            held[lang][-1] = 0
    yield from flush()


@dataclass(frozen=True)
class LanguageModel:
    """Learned languages, their log priors, and log probabilities with a row of zeros for 'no n-gram'."""

    langs: list[str]
    prior: np.ndarray
    log_prob: np.ndarray

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """``lang, top, mass``: of each text the likeliest language, its log score, and all scores relative to it.

        The language of a text that is null or has no letter is null. Ties go to the language that
        sorts first. Log likelihoods are divided by the square root of the number of n-grams: they
        aren't independent, and undivided posteriors of long texts are all 1.
        """
        n, kinds = len(texts), len(self.langs)
        total, seen = np.zeros((n, kinds)), np.zeros(n)
        for piece in pieces([t or "" for t in texts], max(1 << 14, CHUNK_CHARS * 4 // (4 + kinds))):
            rows = np.array([i for i, _ in piece])
            for buckets, starts in gram_buckets([text for _, text in piece]):
                np.add.at(total, rows, np.add.reduceat(self.log_prob[buckets], starts, axis=0, dtype=np.float64))
                np.add.at(seen, rows, np.add.reduceat(buckets < BUCKETS, starts, dtype=np.float64))
        joint = (total + self.prior) / np.sqrt(np.maximum(seen, 1))[:, None]
        top = joint.max(axis=1)
        langs = [self.langs[b] if k else None for b, k in zip(joint.argmax(axis=1), seen > 0, strict=True)]
        return pd.DataFrame({
            "lang": pd.Series(langs, dtype=object), "top": top, "mass": np.exp(joint - top[:, None]).sum(axis=1),
        })


def fit_languages(
    docs: DataFrame, learn_from: Column | None = None, smoothing: float = 0.5, model_langs: int = MODEL_LANGS
) -> Iterator[LanguageModel]:
    """Learn from every document whose ``lang`` and ``text`` are known and for which ``learn_from`` holds.

    Models of at most ``model_langs`` languages each, in the order of the languages; the driver makes one at a time.
    """
    usable = F.col("lang").isNotNull() & F.col("text").isNotNull()
    if learn_from is not None:
        usable = usable & learn_from
    counted = stored(
        docs.filter(usable)
        .select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
        .mapInPandas(count_grams, "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n")),
        "language-grams",
    )
    known = sorted((r["lang"], r["n"]) for r in counted.filter("bucket = -1").collect())
    everything = sum(n for _, n in known)
    for at in range(0, len(known), model_langs):
        langs = [lang for lang, _ in known[at : at + model_langs]]
        found = counted.filter(F.col("lang").between(langs[0], langs[-1]) & (F.col("bucket") >= 0)).toPandas()
        column = found["lang"].map({lang: i for i, lang in enumerate(langs)}).to_numpy(dtype=np.int64)
        counts = np.zeros((BUCKETS, len(langs)))
        counts[found["bucket"].to_numpy(dtype=np.int64), column] = found["n"]
        log_prob = np.zeros((BUCKETS + 1, len(langs)), np.float32)
        log_prob[:-1] = np.log((counts + smoothing) / (counts.sum(axis=0) + smoothing * BUCKETS))
        documents = np.array([n for _, n in known[at : at + model_langs]], float)
        yield LanguageModel(langs, np.log(documents / everything), log_prob)


def language_scores(docs: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """A column ``struct<lang: string, top: double, mass: double>``, see ``LanguageModel.predict``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, top double, mass double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return shared.value.predict([t if isinstance(t, str) else None for t in texts])

    return predict(docs[text].cast("string"))


def predict_languages(docs: DataFrame, models: Iterator[LanguageModel], text: str = "text") -> DataFrame:
    """The table with ``lang_pred`` and ``score``, the posterior over the languages of all models.

    From the second model on the best so far is written with the rows, so a task holds one model only.
    """
    best = fresh(docs.columns, "_best")
    new = fresh([*docs.columns, best], "_new")
    scored = None
    for model in models:
        if scored is None:
            scored = docs.withColumn(best, language_scores(docs, model, text))
            continue
        held = stored(scored, "language-best")
        # Ties stay with the earlier model: its languages sort first.
        scored = held.withColumn(new, language_scores(held, model, text)).withColumn(best, F.expr(
            f"CASE WHEN {new}.top > {best}.top THEN named_struct('lang', {new}.lang, 'top', {new}.top, "
            f"'mass', {new}.mass + {best}.mass * exp({best}.top - {new}.top)) ELSE named_struct('lang', {best}.lang, "
            f"'top', {best}.top, 'mass', {best}.mass + {new}.mass * exp({new}.top - {best}.top)) END"
        )).drop(new)
    if scored is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    return scored.withColumns({
        "lang_pred": F.coalesce(f"{best}.lang", F.lit(UNKNOWN)),
        "score": F.when(F.col(f"{best}.lang").isNull(), 0.0).otherwise(1 / F.col(f"{best}.mass")),
    }).drop(best)


def identify_languages(docs: DataFrame, folds: int = 3, fold: int = 1, model_langs: int = MODEL_LANGS) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``.

    Learns from the documents outside the held-out fold. Null or letterless text: ``und``, score 0; nulls
    in ``lang`` or ``doc_id``: the row is predicted but not learned from; no row to learn from: all
    ``und``; repeated rows each get their row; other columns are ignored.
    """
    models = fit_languages(docs, learnable(F.col("doc_id"), folds, fold), model_langs=model_langs)
    asked = docs.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "text")
    return predict_languages(asked, models).select("doc_id", "held_out", "lang_pred", "score")
