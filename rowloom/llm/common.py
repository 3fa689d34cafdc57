"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.plans.scratch import scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(id_column: Column, folds: int, fold: int) -> Column:
    """Whether a row belongs to the fold no label is learned from; false for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string")) % folds == fold, F.lit(False))


def learnable(id_column: Column, folds: int, fold: int) -> Column:
    """Whether labels of a row may be learned; false for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string")) % folds != fold, F.lit(False))


def fresh(taken: Iterable[str], stem: str) -> str:
    """A column name that the table doesn't use yet, whatever its case."""
    names = {name.lower() for name in taken}
    while stem.lower() in names:
        stem = f"_{stem}"
    return stem


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def labelled_sample(labels: DataFrame, label: str, folds: int, fold: int, bound: int, seed: int = 7) -> DataFrame:
    """Rows ``(doc_id, label)`` to learn from: outside the held-out fold, about ``bound`` at most.

    One row per id; ids whose labels contradict each other are left out. Beyond the bound rows are
    chosen by a hash of the id, so every run takes the same ones.
    """
    rows = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(learnable(F.col("doc_id"), folds, fold) & F.col("label").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("_most"))
        .filter("label = _most")
        .drop("_most")
    )
    there = rows.count()
    if there <= bound:
        return rows
    cut = int(bound / there * (1 << 30))
    return rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < cut)


def labelled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``doc_id, text, label`` of the chosen ids (``labelled_sample``), one row per id; null texts are left out.

    Of several texts of an id the least counts, so there are never more rows than ids.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id").filter("text IS NOT NULL")
    again = rows.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if not again.limit(1).count():
        return rows
    least = rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    return rows.join(again, "doc_id", "left_anti").unionByName(least)


def pieces(texts: Sequence[str], limit: int) -> Iterator[list[tuple[int, str]]]:
    """Lists of ``(index, part of text)`` of about ``limit`` characters, so that memory stays bounded.

    Long texts are cut after white space only; every character is in exactly one part.
    """
    batch: list[tuple[int, str]] = []
    room = limit
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > room:
            cut = max(text.rfind(" ", at, at + room), text.rfind("\n", at, at + room)) + 1
            if cut <= at:
                if batch:
                    yield batch
                    batch, room = [], limit
                    continue
                ends = [x for x in (text.find(" ", at), text.find("\n", at)) if x >= 0]
                cut = min(ends) + 1 if ends else len(text)
            batch.append((i, text[at:cut]))
            at = cut
            yield batch
            batch, room = [], limit
        if at < len(text):
            batch.append((i, text[at:]))
            room -= len(text) - at
            if room <= 0:
                yield batch
                batch, room = [], limit
    if batch:
        yield batch


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound; missing ones are computed on access."""

    BOUND = 400_000

    def __missing__(self, word: str) -> int:
        self[word] = made = self.digest(word.encode("utf-8", "surrogatepass"))
        return made

    @staticmethod
    def digest(word: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > self.BOUND:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """A hash for each run of ``size`` words, from the words' hashes; none for fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    made = words[:n].copy()
    for k in range(1, size):
        made = made * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return mix(made)
