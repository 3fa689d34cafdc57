"""Substring dedup by fixed-block anchors: words that stand in a repeated stretch of 35 words or more go, all copies of it.

Any 35 consecutive words hold a whole block of 18 words that begins at a multiple of 18 in its document. So if the same
35 words stand at two places, each place has a block of its own document that the other place repeats word by word:

1. the texts are dealt to chunks; each chunk sends the hashes of all its *rolling* windows of 18 words, each once, to hash
   ranges and tells which of them are blocks: the index. A range answers with the blocks that some other place repeats;
2. around such an anchor a chunk extends to both sides: the names of the at most 18 windows of 35 words that hold the block
   go to ranges, each once, with their place; a range answers with the places of those that stand elsewhere;
3. the chunk joins overlapping repeated windows to maximal repeats and deletes their words.

Equal windows meet by name, one per chunk, so a passage that a third of all documents shares costs its places, never pairs.
Whole copies need none of that: texts that several rows have are found by a count of 128-bit text hashes first. They are repeated
from beginning to end; one of them stays in the chunks for others to be compared with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from rowloom.llm.common import WordHashes, fresh, mix, stored
from rowloom.plans.joins import lookup

WINDOW = 35
#: The longest block of which every window holds a whole one, wherever it begins.
BLOCK = (WINDOW + 1) // 2
CHUNK_CHARS = 8_000_000
#: A range gets the names of about so many words.
RANGE_WORDS = 2_000_000
FACTOR_1, FACTOR_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class ByteHashes(WordHashes):
    def __missing__(self, word: bytes) -> int:
        self[word] = made = WordHashes.digest(word)
        return made


_hashes = ByteHashes()


def window_hashes(words: np.ndarray, size: int, factor: np.uint64 = FACTOR_1) -> np.ndarray:
    """A hash for each window of ``size`` words, from the words' hashes; built from windows of powers of two."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        made, covered, power, span = np.zeros(n, np.uint64), 0, factor, 1
        level = words
        while covered < size:
            if size & span:
                made = made * power + level[covered : covered + n]
                covered += span
            if covered < size:
                level = level[:-span] * power + level[span:]
                power, span = power * power, span * 2
        return mix(made)


def _pack(numbers: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as byte planes of their differences, which compress well."""
    return np.diff(numbers, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


def _texts(chunk: pa.Table) -> list[bytes]:
    return [t or b"" for t in chunk["text"].cast(pa.binary()).to_pylist()]


def _in_order(chunk: pa.Table) -> pa.Table:
    """Texts of a chunk are distinct, so their hashes put them in the same order in every pass."""
    return chunk.sort_by([("h1", "ascending"), ("h2", "ascending")])


ANNOUNCED = "range int, chunk int, names binary, twice binary, blocks binary"
REPLIED = "chunk int, range int, names binary"
ASKED = "range int, chunk int, names binary, places binary, twice binary, known binary"
PLACES = "chunk int, places binary"


def announce(bits: int, chunk: pa.Table) -> pa.Table:
    """By range, the distinct names of the chunk's rolling windows of a block's size: which stand twice in it, which are blocks."""
    rolling, blocks = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for text in _texts(chunk):
        words = text.split()
        if len(words) >= WINDOW:
            rolling.append(window_hashes(_hashes.of(words), BLOCK) >> np.uint64(32 - bits))
            blocks.append(rolling[-1][::BLOCK])
    names, counts = np.unique(np.concatenate(rolling), return_counts=True)
    is_block = np.zeros(len(names), bool)
    is_block[np.searchsorted(names, np.concatenate(blocks))] = True
    ranges, low = (names >> np.uint64(32)).astype(np.int32), names.astype(np.uint32)
    at, first = np.unique(ranges, return_index=True)
    spans = list(zip(first, np.append(first, len(names))[1:], strict=True))
    return pa.table({
        "range": pa.array(at, pa.int32()), "chunk": pa.array(np.full(len(at), chunk["chunk"][0].as_py(), np.int32)),
        "names": pa.array([_pack(low[a:b]) for a, b in spans], pa.binary()),
        "twice": pa.array([_bits(counts[a:b] >= 2) for a, b in spans], pa.binary()),
        "blocks": pa.array([_bits(is_block[a:b]) for a, b in spans], pa.binary()),
    })


def anchors(sent: pa.Table) -> pa.Table:
    """To every chunk, which of its blocks stand at another place too: in another chunk or again in its own."""
    parts = [_unpack(x) for x in sent["names"].to_pylist()]
    twice = [p[_flags(x, len(p))] for p, x in zip(parts, sent["twice"].to_pylist(), strict=True)]
    every = np.sort(np.concatenate([*parts, *twice]))
    chunks, ranges, names = [], [], []
    for chunk, at, part, blocks in zip(sent["chunk"].to_pylist(), sent["range"].to_pylist(), parts, sent["blocks"].to_pylist(), strict=True):
        mine = part[_flags(blocks, len(part))]
        mine = mine[np.searchsorted(every, mine, "right") - np.searchsorted(every, mine, "left") >= 2]
        if len(mine):
            chunks.append(chunk)
            ranges.append(at)
            names.append(_pack(mine))
    return pa.table({"chunk": pa.array(chunks, pa.int32()), "range": pa.array(ranges, pa.int32()), "names": pa.array(names, pa.binary())})


def extend(bits: int, chunk: pa.Table, replied: pa.Table) -> pa.Table:
    """The windows around the chunk's anchors, by range: names and places of those that stand once in the chunk.

    Of windows that stand several times in the chunk the name goes out with a mark, and the places are ``known`` already.
    """
    empty = pa.table({c.split(" ")[0]: pa.array([], pa.int32() if c.endswith("int") else pa.binary()) for c in ASKED.split(", ")})
    if not len(replied) or not len(chunk):
        return empty
    anchored = np.sort(np.concatenate([
        (np.uint64(r) << np.uint64(32)) | _unpack(x).astype(np.uint64)
        for r, x in zip(replied["range"].to_pylist(), replied["names"].to_pylist(), strict=True)
    ]))
    first, second, places, offset = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], 0
    for text in _texts(_in_order(chunk)):
        words = text.split()
        n = len(words)
        if n >= WINDOW:
            hashes = _hashes.of(words)
            own = window_hashes(hashes, BLOCK)[::BLOCK] >> np.uint64(32 - bits)
            hit = np.flatnonzero(anchored[np.minimum(np.searchsorted(anchored, own), len(anchored) - 1)] == own) * BLOCK
            if len(hit):
                starts = np.zeros(n - WINDOW + 2, np.int32)
                np.add.at(starts, np.maximum(hit - (WINDOW - BLOCK), 0), 1)
                np.add.at(starts, np.minimum(hit, n - WINDOW) + 1, -1)
                at = np.flatnonzero(np.cumsum(starts[:-1]) > 0)
                first.append(window_hashes(hashes, WINDOW)[at])
                second.append(window_hashes(hashes, WINDOW, FACTOR_2)[at])
                places.append((at + offset).astype(np.uint32))
        offset += n
    one, two, place = np.concatenate(first), np.concatenate(second), np.concatenate(places)
    if not len(one):
        return empty
    ranges = (one >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(one), np.int32)
    names = ((one << np.uint64(bits)) & np.uint64(0xFFFFFFFF00000000)) | (two >> np.uint64(32))
    order = np.lexsort((place, names, ranges))
    ranges, names, place = ranges[order], names[order], place[order]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (ranges[1:] != ranges[:-1])
    number = np.cumsum(new) - 1
    several = np.bincount(number) > 1
    heads = np.flatnonzero(new)
    at, begin = np.unique(ranges[heads], return_index=True)
    rows = []
    for r, a, b in zip(at.tolist(), begin.tolist(), np.append(begin[1:], len(heads)).tolist(), strict=True):
        mine = slice(heads[a], heads[b] if b < len(heads) else len(names))
        rows.append((
            r, names[heads[a:b]].astype("<u8").tobytes(), place[heads[a:b]].astype("<u4").tobytes(), _bits(several[a:b]),
            place[mine][several[number[mine]]].astype("<u4").tobytes(),
        ))
    return pa.table({
        "range": pa.array([x[0] for x in rows], pa.int32()), "chunk": pa.array([chunk["chunk"][0].as_py()] * len(rows), pa.int32()),
        **{c: pa.array([x[k] for x in rows], pa.binary()) for k, c in enumerate(("names", "places", "twice", "known"), 1)},
    })


def elsewhere(asked: pa.Table) -> pa.Table:
    """To every chunk, the places of its windows that stand at another place too."""
    parts = [np.frombuffer(x, "<u8") for x in asked["names"].to_pylist()]
    twice = [_flags(x, len(p)) for p, x in zip(parts, asked["twice"].to_pylist(), strict=True)]
    every = np.sort(np.concatenate(parts))
    again = np.unique(every[1:][every[1:] == every[:-1]])
    chunks, found = [], []
    for chunk, names, own, places, known in zip(asked["chunk"].to_pylist(), parts, twice, asked["places"].to_pylist(), asked["known"].to_pylist(), strict=True):
        there = (again[np.minimum(np.searchsorted(again, names), len(again) - 1)] == names) & ~own if len(again) else np.zeros(len(names), bool)
        both = np.concatenate([np.frombuffer(places, "<u4")[there], np.frombuffer(known, "<u4")])
        if len(both):
            chunks.append(chunk)
            found.append(both.astype("<u4").tobytes())
    return pa.table({"chunk": pa.array(chunks, pa.int32()), "places": pa.array(found, pa.binary())})


def cut(chunk: pa.Table, found: pa.Table) -> pa.Table:
    """The chunk's documents without the words of their maximal repeats; texts that only stand in for copies go."""
    chunk = _in_order(chunk)
    places = np.sort(np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(x, "<u4") for x in found["places"].to_pylist())])).astype(np.int64)
    counts, removed, kept, offset = [], [], [], 0
    for text in _texts(chunk):
        words = text.split()
        n = len(words)
        mine = places[np.searchsorted(places, offset) : np.searchsorted(places, offset + n)] - offset
        offset += n
        counts.append(n)
        if not len(mine):
            removed.append(0)
            kept.append(b" ".join(words))
            continue
        turns = np.bincount(mine, minlength=n + 1) - np.bincount(mine + WINDOW, minlength=n + 1)
        left = np.flatnonzero(np.cumsum(turns[:n]) == 0)
        removed.append(n - len(left))
        kept.append(b" ".join([words[i] for i in left.tolist()]))
    whole = pa.table({
        "row": chunk["row"], "text": pa.array(kept, pa.binary()).cast(pa.string()),
        "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
    })
    return whole.filter(chunk["single"])


def drop_substrings(docs: DataFrame, text: str = "text") -> DataFrame:
    """The table with ``text`` cut down to the words outside of repeats, joined by one space, plus ``n_words`` and ``n_removed``.

    Words are what ASCII white space separates, compared unchanged. A word goes if any 35 consecutive words that hold it also
    start at another place, in the same document or another; all copies go alike, and places are judged on the
    input. Null and empty texts have no words and become empty; a repeated row is a copy of the other, with or without ids; other
    columns stay. Where a new column's name is taken it gets a leading underscore. An empty table gives an empty one.
    """
    names = docs.columns
    read = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names if c != text] or [F.lit(None).cast("int").alias("_none")]).alias("row"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )
    body = F.coalesce(F.col("text"), F.lit(""))
    read = read.withColumns({"h1": F.xxhash64(body), "h2": F.xxhash64(F.lit(11), body)})
    size = read.agg(F.sum(F.length("text")).alias("chars")).first()["chars"] or 0
    chunks = max(1, -(-size // CHUNK_CHARS))
    bits = max(0, (max(1, -(-size // (6 * RANGE_WORDS))) - 1).bit_length())
    copied = stored(read.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("h1", "h2", F.lit(True).alias("copied")), "copied")
    marked = lookup(read, copied, ["h1", "h2"])
    # Of copies one text goes along; equal texts of a task are one before they travel.
    copies = marked.filter("copied")
    one = copies.filter(F.length("text") >= 2 * WINDOW - 1).groupBy("h1", "h2", "text").agg(F.lit(False).alias("single"))
    one = one.select(F.lit(None).cast(read.schema["row"].dataType).alias("row"), "text", "h1", "h2", "single")
    singles = marked.filter("copied IS NULL").select("row", "text", "h1", "h2", F.lit(True).alias("single"))
    dealt = singles.unionByName(one).withColumn("chunk", F.pmod("h1", F.lit(chunks)).cast("int")).repartition("chunk")
    slim = dealt.select("chunk", "text", "h1", "h2")

    announced = slim.groupBy("chunk").applyInArrow(lambda chunk: announce(bits, chunk), ANNOUNCED)
    replied = announced.groupBy("range").applyInArrow(anchors, REPLIED)
    asked = dealt.groupBy("chunk").cogroup(replied.groupBy("chunk")).applyInArrow(lambda chunk, back: extend(bits, chunk, back), ASKED)
    found = asked.groupBy("range").applyInArrow(elsewhere, PLACES)
    shape = StructType([StructField("row", dealt.schema["row"].dataType), *StructType.fromDDL("text string, n_words bigint, n_removed bigint")])
    final = dealt.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(cut, shape)
    words = F.expr("filter(split(text, '[ \\\\t-\\\\r]+'), w -> w != '')")
    whole = copies.withColumn("_w", words).withColumn("n_words", F.coalesce(F.size("_w"), F.lit(0)).cast("bigint"))
    whole = whole.withColumn("_all", F.col("n_words") >= WINDOW).select(
        "row", F.when(F.col("_all"), "").otherwise(F.coalesce(F.array_join("_w", " "), F.lit(""))).alias("text"), F.col("n_words"),
        F.when(F.col("_all"), F.col("n_words")).otherwise(0).cast("bigint").alias("n_removed"),
    )
    made = final.unionByName(whole)
    return made.select(
        *[(F.col("text") if c == text else F.col("row")[c]).alias(c) for c in names],
        *[F.col(c).alias(fresh(names, c)) for c in ("n_words", "n_removed")],
    )


def substring_digest(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id, n_words, n_removed, kept_sha256``, the last of the words that are left; see ``drop_substrings``."""
    made = drop_substrings(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")))
    return made.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: For tables without repeated ids. Windows meet by their text.
ORACLE = f"""
WITH w AS (
  SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '),
    lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW}),
k AS (SELECT s.doc_id, s.i, md5(array_to_string(w.w[s.i:s.i + {WINDOW - 1}], ' ')) AS k FROM s JOIN w ON w.doc_id = s.doc_id),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM k) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, i + j AS p FROM r, (SELECT unnest(range(0, {WINDOW})) AS j)),
p AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM w),
c AS (
  SELECT p.doc_id, count(g.p) AS n_removed, string_agg(p.t, ' ' ORDER BY p.p) FILTER (WHERE g.p IS NULL) AS kept
  FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.p = p.p GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(c.kept, '')) AS kept_sha256
FROM w LEFT JOIN c ON c.doc_id = w.doc_id
"""
