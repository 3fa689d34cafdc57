"""Periodic runs of words: Lyndon arrays by the grouping phase of a suffix sorter, roots extended to runs.

A run is a stretch of words that repeats with its smallest period and that no neighbouring word extends. Its Lyndon root
under one of two opposite orders of the words is the longest Lyndon word at each of its places (the runs theorem), so
the longest Lyndon word at every place, under both orders, names every run. The first phase of Baier's suffix
sorter finds these words directly: suffixes start in groups by their first word; groups are taken from the greatest
down, and each member lengthens the word of the nearest place before it that is in a lower group. What a
group's word is when its turn comes is the longest Lyndon word of its members. No suffix array is built.

Each root is then extended to both sides as far as the words a period apart are equal. All of this is local to a
document: no shuffle, and a long document is one row of one task. Only stretches in which every five words stand more
than once in the document can hold a run of four periods and six words, so only these are grouped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import WordHashes, fresh, mix, shingle_hashes

#: The shortest run, in words and in periods; the filter by grams needs at least these.
MIN_WORDS = 6
MIN_PERIODS = 4
GRAM = 5
#: Documents are looked through together up to so many words.
BATCH_WORDS = 500_000
FOUND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.int64())), ("collapsed", pa.string())])

Run = tuple[int, int, int]


class ByteHashes(WordHashes):
    def __missing__(self, word: bytes) -> int:
        self[word] = made = WordHashes.digest(word)
        return made


_hashes = ByteHashes()


def lyndon_array(ranks: np.ndarray) -> np.ndarray:
    """The length of the longest Lyndon word at each place of a sequence, under the order of the given dense ranks.

    Places that have had their turn leave the linked list of places, so the neighbour to the left of a member, or of
    the chain of members it stands in, is in a lower group: its word is lengthened by the chain.
    """
    n = len(ranks)
    if not n:
        return np.zeros(0, np.int64)
    first = int(ranks.max()) + 1
    order = np.argsort(ranks, kind="stable")
    members = [part.tolist() for part in np.split(order, np.searchsorted(ranks[order], np.arange(1, first)))]
    lengths, below, above = [1] * first, list(range(-1, first - 1)), list(range(1, first + 1))
    # Number n stands for the outside of the sequence at both ends and is in no group.
    group_of = [*ranks.tolist(), -1]
    left, right = [n, *range(n)], [*range(1, n + 1), 0]
    found = [1] * n
    group = first - 1
    while group >= 0:
        length, longer = lengths[group], {}
        for i in members[group]:
            if group_of[i] != group:
                continue
            found[i] = length
            before = left[i]
            if group_of[before] == group:
                continue
            chain, after = 1, right[i]
            while group_of[after] == group:
                chain += 1
                after = right[after]
            right[before], left[after] = after, before
            if before != n:
                longer.setdefault((group_of[before], chain), []).append(before)
        members[group] = ()
        # The lengthened words go directly above the group they were in, the longest chains first.
        for (lower, chain), moved in sorted(longer.items(), reverse=True):
            made, upper = len(lengths), above[lower]
            lengths.append(lengths[lower] + chain * length)
            members.append(moved)
            below.append(lower)
            above.append(upper)
            above[lower] = made
            if upper < made:
                below[upper] = made
            for i in moved:
                group_of[i] = made
        group = below[group]
    return np.array(found, np.int64)


def _equal(x: np.ndarray, y: np.ndarray) -> int:
    """How many leading items of two sequences are equal, looked at in ever longer blocks."""
    most, at, step = min(len(x), len(y)), 0, 16
    while at < most:
        differ = np.flatnonzero(x[at : at + step] != y[at : min(at + step, most)]) if at + step <= most else np.flatnonzero(x[at:most] != y[at:most])
        if len(differ):
            return at + int(differ[0])
        at, step = min(at + step, most), step * 2
    return most


def runs_of(words: np.ndarray) -> set[Run]:
    """All runs ``(start, length, period)`` of at least MIN_WORDS words and MIN_PERIODS periods in a sequence of numbers."""
    n, found = len(words), set()
    if n < MIN_WORDS:
        return found
    ranks = np.unique(words, return_inverse=True)[1]
    places = np.arange(n)
    for order in (ranks, ranks.max() - ranks):
        root = lyndon_array(order)
        # Of four periods at least three whole roots stand one after the other.
        second, third = np.minimum(places + root, n - 1), np.minimum(places + 2 * root, n - 1)
        likely = np.flatnonzero((places + 3 * root <= n) & (root[second] == root) & (root[third] == root))
        ends: dict[int, int] = {}
        for i, period in zip(likely.tolist(), root[likely].tolist(), strict=True):
            if ends.get(period, 0) >= i + period:
                continue  # in the run of this period that was found last
            end = i + period + _equal(words[i:], words[i + period :])
            start = i - _equal(words[:i][::-1], words[period : i + period][::-1])
            ends[period] = end
            if end - start >= max(MIN_WORDS, MIN_PERIODS * period):
                found.add((start, end - start, period))
    return found


def _stretches(hashes: Sequence[np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """``(document, start, end)`` of the stretches in which every gram stands twice or more in the document."""
    grams = [mix(shingle_hashes(h, GRAM) + np.uint64(k)) for k, h in enumerate(hashes)]
    every = np.concatenate([*grams, np.zeros(0, np.uint64)])
    ordered = np.sort(every)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return
    marked = again[np.minimum(np.searchsorted(again, every), len(again) - 1)] == every
    at = 0
    for k, own in enumerate(grams):
        mine = marked[at : at + len(own)]
        at += len(own)
        if not mine.any():
            continue
        turns = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0))
        for start, last in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            if last - start + GRAM - 1 >= MIN_WORDS:
                yield k, start, last + GRAM - 1


def _collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def _look_through(texts: list[list[bytes]]) -> Iterator[tuple[list[Run], bytes]]:
    hashes = [_hashes.of(words) for words in texts]
    found: dict[int, set[Run]] = {}
    for k, start, end in _stretches(hashes):
        found.setdefault(k, set()).update((start + s, length, p) for s, length, p in runs_of(hashes[k][start:end]))
    for k, words in enumerate(texts):
        runs = sorted(found.get(k, ()), key=lambda r: (r[0], r[2]))
        yield runs, _collapsed(words, runs) if runs else b" ".join(words)


def runs_in(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """For each text its number of words, its runs one after the other, and the words that are left."""
    for batch in texts:
        counts, flat, left = [], [], []

        def flush(held: list[list[bytes]]) -> None:
            for runs, kept in _look_through(held):
                flat.append([x for run in runs for x in run])
                left.append(kept)

        held, room = [], BATCH_WORDS
        for text in batch.cast(pa.binary()):
            held.append((text.as_py() or b"").split())
            counts.append(len(held[-1]))
            room -= counts[-1]
            if room <= 0:
                flush(held)
                held, room = [], BATCH_WORDS
        flush(held)
        yield pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(flat, pa.list_(pa.int64())), pa.array(left, pa.binary()).cast(pa.string())],
            fields=list(FOUND),
        )


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The table with ``n_words``, ``runs`` and ``collapsed``.

    Words are what ASCII white space separates, numbered from 0. ``runs`` holds ``start, length, period`` of every run
    of at least six words and four periods, by start and then period; ``collapsed`` is the text, its words joined by one space, without
    those that any run contains after its first period. Null and empty texts have no words, no runs and an empty
    ``collapsed``; every row is looked at for itself, so repeated rows and null ids are no special case; other columns stay.
    Where a new column's name is taken it gets a leading underscore.
    """

    @F.arrow_udf("n_words bigint, runs array<bigint>, collapsed string")
    def looked(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return runs_in(texts)

    names, own = docs.columns, fresh(docs.columns, "_found")
    made = docs.withColumn(own, looked(F.col(f"`{text}`").cast("string")))
    runs = F.expr(
        f"transform(sequence(0, size(`{own}`.runs) div 3 - 1 + IF(size(`{own}`.runs) = 0, 1, 0)), i -> named_struct("
        f"'start', get(`{own}`.runs, 3 * i), 'length', get(`{own}`.runs, 3 * i + 1), 'period', get(`{own}`.runs, 3 * i + 2)))"
    )
    new = {
        "n_words": F.col(own)["n_words"], "collapsed": F.col(own)["collapsed"],
        "runs": F.filter(runs, lambda r: r["start"].isNotNull()),
    }
    return made.select(
        *[F.col(f"`{c}`") for c in names], *[new[c].alias(fresh(names, c)) for c in ("n_words", "runs", "collapsed")]
    )


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: of every tenth document, by a hash of its id, the words from some place on repeat.

    With h the id's crc32 and g = floor(h / 10), where h is a multiple of 10 each word from number a = g % n on becomes the
    word a + (i - a) % p, for p = 1 + floor((n - a) / (3 + g % 8)). Rows without an id stay as they are.
    """
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = read.withColumn("_h", F.crc32(F.col("doc_id").cast("string")))
    words = F.expr("IF(_h % 10 = 0, filter(split(text, '[ \\\\t-\\\\r]+'), w -> w != ''), NULL)")
    read = read.withColumn("_w", words).withColumn("_n", F.expr("coalesce(CAST(size(_w) AS BIGINT), 0L)"))
    read = read.withColumn("_a", F.expr("IF(_w IS NULL OR _n <= 0, 0L, (_h div 10) % _n)"))
    read = read.withColumn("_p", F.expr("1 + (_n - _a) div (3 + (_h div 10) % 8)"))
    turned = F.expr("array_join(transform(_w, (w, i) -> IF(i < _a, w, get(_w, CAST(_a + (i - _a) % _p AS INT)))), ' ')")
    return read.select("doc_id", F.when(F.col("_w").isNotNull() & (F.col("_n") > 0), turned).otherwise(F.col("text")).alias("text"))


def run_digest(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id, n_runs``, the longest run and hashes of all runs and of what is left; see ``find_runs``.

    Of equally long runs the one with the smallest start counts, then the one with the smallest period; without runs
    ``start, length, period, exponent_milli`` are null. Null texts and ids are kept as rows.
    """
    found = find_runs(docs.select("doc_id", "text"))
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    found = found.withColumn("best", best)

    def of_best(shown: Column) -> Column:
        return shown.cast("bigint")

    return found.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.size("runs").cast("bigint").alias("n_runs"),
        of_best(-F.col("best")["start"]).alias("start"),
        of_best(F.col("best")["length"]).alias("length"),
        of_best(-F.col("best")["period"]).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
