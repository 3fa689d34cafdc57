"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

An item's fingerprint has 128 bits from its five-word shingles. In a document a window of the item's
size gets the same kind of fingerprint from prefix sums. Fingerprints are cut into blocks, and each size has
a table per block from values to items. The radii of the blocks and one more for each add up to more than
the radius, so two fingerprints within it are within a block's radius in some block and looking up blocks
loses none. What the tables give is scored by the whole fingerprint, in slices of bounded size, and
verified by the weighted Jaccard similarity of the two bags of shingles. A window that shares no
shingle with any item can't be verified, whatever its fingerprint, so only windows around shared
shingles get one; this changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import WordHashes, fresh, mix, pieces, shingle_hashes, stored

SHINGLE = 5
SIMILARITY = 0.8
BITS, BLOCKS = 128, 8
#: At similarity 0.8 fingerprints differ in 19.4 bits with a standard deviation of 4.1; this is four of them more.
RADIUS = 36
#: Radius in each block. Fingerprints farther apart than this in every block differ in more than ``RADIUS`` bits.
RADII = np.array([RADIUS // BLOCKS - (b > RADIUS % BLOCKS) for b in range(BLOCKS)])
#: Pairs of a window and an item, and shingles' votes, that are held at once.
SLICE_PAIRS, SLICE_VOTES = 1 << 20, 1 << 13
#: Words of the items that one pass holds; a larger benchmark takes several passes.
PASS_WORDS = 4_000_000
CHUNK_CHARS = 1 << 22
MATCHES = "array<struct<item_id: bigint, similarity: double, first_word: bigint, n_words: bigint>>"

_word = re.compile(r"\w+")
_hashes = WordHashes()
POP16 = np.array([x.bit_count() for x in range(1 << 16)], np.uint8)
#: Per radius the differences that a block value may have.
BALLS = {int(r): np.flatnonzero(POP16 <= r).astype(np.uint16) for r in np.unique(RADII)}


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words (letters, digits, underscores; lower case) of a text."""
    return _hashes.of(_word.findall(text.lower()))


def lanes(hashes: np.ndarray) -> np.ndarray:
    """Each shingle's vote, -1 or 1, for each bit of a fingerprint."""
    both = np.column_stack([hashes, mix(hashes + np.uint64(0x632BE59BD9B4E019))])
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def blocks_of(votes: np.ndarray) -> np.ndarray:
    """Fingerprints from summed votes, as 16-bit blocks."""
    return np.packbits(votes > 0, axis=1).view(np.uint16)


def votes_of(hashes: np.ndarray) -> np.ndarray:
    """Summed votes of all shingles, as one row."""
    return sum(lanes(hashes[i : i + SLICE_VOTES]).sum(axis=0, keepdims=True) for i in range(0, len(hashes), SLICE_VOTES))


def votes_until(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Summed votes of the shingles before each of the places, which are in order."""
    made, total = np.empty((len(places), BITS), np.int32), np.zeros((1, BITS), np.int32)
    for i in range(0, len(hashes) + 1, SLICE_VOTES):
        sums = np.cumsum(np.vstack([total, lanes(hashes[i : i + SLICE_VOTES])]), axis=0, dtype=np.int32)
        a, b = np.searchsorted(places, [i, i + SLICE_VOTES])
        made[a:b], total = sums[places[a:b] - i], sums[-1:]
    return made


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class BlockTable:
    """From the values of one block to the items that have them there."""

    def __init__(self, values: np.ndarray, radius: int) -> None:
        self.items = np.argsort(values, kind="stable")
        self.values, first = np.unique(values[self.items], return_index=True)
        self.first, self.radius = np.append(first, len(values)), radius
        self.place = None
        if len(self.values) > len(BALLS[radius]):
            self.place = np.full(1 << 16, -1, np.int32)
            self.place[self.values] = np.arange(len(self.values))

    def near(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``asked`` and items within the radius. What there are fewer of is gone through: values around, or values held."""
        if self.place is None:
            row, value = np.nonzero(POP16[asked[:, None] ^ self.values] <= self.radius)
        else:
            held = self.place[asked[:, None] ^ BALLS[self.radius]]
            row, at = np.nonzero(held >= 0)
            value = held[row, at]
        lengths = self.first[value + 1] - self.first[value]
        return np.repeat(row, lengths), self.items[spread(self.first[value], lengths)]


class SizeIndex:
    """Multi-index over the fingerprints of the items of one size."""

    def __init__(self, items: np.ndarray, prints: np.ndarray) -> None:
        self.items, self.prints = items, np.ascontiguousarray(prints)
        self.tables = [BlockTable(self.prints[:, b], int(RADII[b])) for b in range(BLOCKS)]

    def near(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Slices of all pairs of a window and an item within ``RADIUS``, by window and item in order."""
        whole, step = self.prints.view(np.uint64), max(1, SLICE_PAIRS // len(self.items))
        for begin in range(0, len(windows), step):
            some = np.ascontiguousarray(windows[begin : begin + step])
            asked, rows, items = some.view(np.uint64), [], []
            for b, table in enumerate(self.tables):
                row, item = table.near(some[:, b])
                apart = sum(np.bitwise_count(asked[row, k] ^ whole[item, k]) for k in range(asked.shape[1]))
                row, item = row[apart <= RADIUS], item[apart <= RADIUS]
                # A pair that an earlier table gives is there already.
                new = (POP16[some[row, :b] ^ self.prints[item, :b]] > RADII[:b]).all(axis=1)
                rows.append(row[new])
                items.append(item[new])
            row, item = np.concatenate(rows), np.concatenate(items)
            order = np.lexsort((item, row))
            yield row[order] + begin, self.items[item[order]]


def similarity(left: np.ndarray, right: np.ndarray) -> float:
    """Weighted Jaccard of two bags: a shingle's weight is the number of times it occurs."""
    a, n = np.unique(left, return_counts=True)
    b, m = np.unique(right, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    common = int(np.minimum(n[i], m[j]).sum())
    total = len(left) + len(right) - common
    return common / total if total else 0.0


@dataclass(frozen=True)
class Benchmark:
    """Items of at least five words: their ids, sizes in words and shingles."""

    ids: list[int | None]
    sizes: np.ndarray
    bags: list[np.ndarray]

    @cached_property
    def longest(self) -> int:
        return int(self.sizes.max(initial=0))

    @cached_property
    def prints(self) -> np.ndarray:
        return np.vstack([blocks_of(votes_of(b)) for b in self.bags])

    @cached_property
    def of_size(self) -> dict[int, SizeIndex]:
        order = np.argsort(self.sizes, kind="stable")
        sizes, first = np.unique(self.sizes[order], return_index=True)
        return {int(s): SizeIndex(i, self.prints[i]) for s, i in zip(sizes, np.split(order, first[1:]), strict=True)}

    @cached_property
    def shared(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingles in order, where the sizes of the items that have each one begin, and these sizes."""
        every = np.concatenate(self.bags)
        size = np.repeat(self.sizes, [len(b) for b in self.bags])
        order = np.lexsort((size, every))
        every, size = every[order], size[order]
        new = np.append(True, (every[1:] != every[:-1]) | (size[1:] != size[:-1]))
        distinct, first = np.unique(every[new], return_index=True)
        return distinct, np.append(first, new.sum()), size[new]

    @cached_property
    def mask(self) -> np.ndarray:
        """A quick test: whether the low bits of a shingle are those of some item's."""
        distinct = self.shared[0]
        bits = min(27, max(16, int(len(distinct)).bit_length() + 6))
        made = np.zeros(1 << bits, bool)
        made[distinct & np.uint64((1 << bits) - 1)] = True
        return made

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("ids", "sizes", "bags")}

    def hits(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of shingles that some item has, and their numbers among the distinct ones."""
        distinct = self.shared[0]
        at = np.flatnonzero(self.mask[found & np.uint64(len(self.mask) - 1)])
        number = np.minimum(np.searchsorted(distinct, found[at]), len(distinct) - 1)
        real = distinct[number] == found[at]
        return at[real], number[real]

    def search(self, words: np.ndarray, best: dict[int, tuple[float, int, int]], offset: int) -> None:
        """Enter into ``best`` each item's most similar window of a document part that starts at ``offset``."""
        found = shingle_hashes(words, SHINGLE)
        if not len(found):
            return
        at, number = self.hits(found)
        if not len(at):
            return
        _, first, sizes = self.shared
        # Sizes are looked up once for each distinct shingle, however often it occurs here or in the items.
        number, which = np.unique(number, return_inverse=True)
        lengths = first[number + 1] - first[number]
        owner, sizes = np.repeat(np.arange(len(number)), lengths), sizes[spread(first[number], lengths)]
        order = np.argsort(sizes, kind="stable")
        begins = np.flatnonzero(np.append(True, np.diff(sizes[order]) > 0))
        for mine in np.split(order, begins[1:]):
            size, held = sizes[mine[0]], np.zeros(len(number), bool)
            held[owner[mine]] = True
            here = at[held[which]]
            # Starts of all windows of this size that hold a shared shingle; at the ends a window is cut off.
            edge = np.zeros(len(words) + int(size) + 1, np.int32)
            reach = int(size) - SHINGLE
            np.add.at(edge, here, 1)
            np.add.at(edge, here + reach + 1, -1)
            starts = np.flatnonzero(np.cumsum(edge) > 0) - reach
            self._search_size(int(size), starts, found, len(words), best, offset)

    def _search_size(self, size: int, starts: np.ndarray, found: np.ndarray, n: int, best: dict, offset: int) -> None:
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1):
            for some in np.array_split(part, max(1, len(part) // 4096)):
                low = np.maximum(some, 0)
                high = np.minimum(some + size, n) - SHINGLE + 1
                low, high = low[high > low], high[high > low]
                if not len(low):
                    continue
                base = int(low[0])
                ends, where = np.unique(np.concatenate([low, high]) - base, return_inverse=True)
                votes = votes_until(found[base : int(high.max())], ends)
                windows = blocks_of(votes[where[len(low) :]] - votes[where[: len(low)]])
                for rows, items in self.of_size[size].near(windows):
                    for w, i in zip(rows.tolist(), items.tolist(), strict=True):
                        alike = similarity(found[low[w] : high[w]], self.bags[i])
                        if alike >= SIMILARITY and (i not in best or alike > best[i][0]):
                            best[i] = (alike, offset + int(low[w]), int(high[w] - low[w]) + SHINGLE - 1)


def matches(benchmark: Benchmark, texts: Sequence[str | None]) -> list[list[dict]]:
    """For each text the items it holds, with the most similar window (the first of equals)."""
    best: list[dict] = [{} for _ in texts]
    last, tail, done = -1, np.zeros(0, np.uint64), 0
    for piece in pieces([t or "" for t in texts], CHUNK_CHARS):
        for i, text in piece:
            if i != last:
                last, tail, done = i, tail[:0], 0
            words = np.concatenate([tail, word_hashes(text)])
            benchmark.search(words, best[i], done - len(tail))
            done += len(words) - len(tail)
            tail = words[max(0, len(words) - 2 * benchmark.longest) :]
    return [
        [
            {"item_id": benchmark.ids[k], "similarity": s, "first_word": a, "n_words": n}
            for k, (s, a, n) in sorted(found.items())
        ]
        for found in best
    ]


def load_benchmark(items: DataFrame) -> Iterator[Benchmark]:
    """The benchmark in parts of about ``PASS_WORDS`` words, each small enough to broadcast.

    Items of fewer than five words have no shingle and take no part; null texts neither.
    """
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-chars // (PASS_WORDS * 6)))
    for part in range(parts):
        mine = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else rows
        found = [(r.item_id, word_hashes(r.text)) for r in mine.toLocalIterator()]
        found = [(i, w) for i, w in found if len(w) >= SHINGLE]
        if found:
            yield Benchmark([i for i, _ in found], np.array([len(w) for _, w in found]), [shingle_hashes(w, SHINGLE) for _, w in found])


def matched_items(docs: DataFrame, benchmark: Benchmark, text: str = "text") -> Column:
    """A column with the matched items of each text; empty for null and short texts."""
    shared = docs.sparkSession.sparkContext.broadcast(benchmark)

    @F.pandas_udf(MATCHES)
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series(matches(shared.value, [t if isinstance(t, str) else None for t in texts]), dtype=object)

    return find(docs[text].cast("string"))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Each document and item it holds: ``doc_id, item_id, similarity, first_word, n_words``, the best window's.

    Null and empty texts hold none; null ids keep their rows; repeated rows give repeated results; items with
    equal text are all reported; an empty benchmark gives an empty result; other columns are ignored.
    """
    parts = [docs.select("doc_id", F.explode(matched_items(docs, b)).alias("m")) for b in load_benchmark(items)]
    if not parts:
        parts = [docs.select("doc_id", F.explode(F.lit(None).cast(MATCHES)).alias("m"))]
    made = parts[0]
    for part in parts[1:]:
        made = made.unionByName(part)
    return made.select("doc_id", "m.*")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns.

    Null and empty texts hold none and stay; null ids are judged like others; repeated rows are judged alike; an empty
    table stays empty; without items of five words or more every document stays.
    """
    names = docs.columns
    for number, benchmark in enumerate(load_benchmark(items)):
        if number:
            docs = stored(docs, "decontaminated")
        name = fresh(names, "_items")
        docs = docs.withColumn(name, matched_items(docs, benchmark)).filter(F.size(name) == 0).select(*[F.col(f"`{c}`") for c in names])
    return docs
