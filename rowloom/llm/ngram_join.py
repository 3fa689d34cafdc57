"""N-gram Jaccard self-join: prefix filters under several global token orders, intersected before verification.

A document's tokens are hashes of its distinct five-word shingles. Under any one order of all tokens two sets
with Jaccard similarity of at least 0.8 share one of their first ``n - ceil(0.8 n) + 1`` tokens. The orders
here put rare tokens first. Document frequencies are counted exactly, in blocks:

1. documents are dealt to chunks of bounded size; a chunk announces its distinct tokens to token ranges;
2. each range adds up frequencies and tells every chunk which of its tokens occur in two documents or more;
3. the chunk drops documents of which too few tokens do, and keeps prefixes of the others.

So what a document shares with a third of the corpus never is a key unless nearly all of it is shared. Equal sets
become one node. Nodes meet where they share a token of the first order's prefix: first each with
one node of its group, then only across components that are still apart, so a large group of near copies
costs its size, not its square. Pairs must also share prefix tokens under the other orders, and are then verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import WordHashes, fresh, mix, shingle_hashes, stored
from rowloom.plans.joins import lookup, without_match

SHINGLE = 5
#: Similarity as a fraction: 100 * intersection >= 80 * union.
PERCENT = 80
#: Texts of a chunk and of a token range; from ``BLOCK_SIDES`` chunks on both grow with the corpus, up to ``GROWN`` times.
CHUNK_CHARS = 8_000_000
RANGE_CHARS = 8_000_000
BLOCK_SIDES, GROWN = 4_096, 8
#: Rows of a token that meet the others of it in one task.
SLICE_ROWS = 1_000
#: Copies of a row that are written out by one step.
REPEAT_ROWS = 10_000
#: Rounds in which the members of a group that is still apart meet one member only, before all of them meet.
STAR_ROUNDS = 3
ORDER_A, ORDER_B, ORDER_C = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)
SET_1, SET_2 = np.uint64(0x589965CC75374CC3), np.uint64(0x1D8E4E27C47D124F)


class ByteHashes(WordHashes):
    def __missing__(self, word: bytes) -> int:
        self[word] = made = WordHashes.digest(word)
        return made


_hashes = ByteHashes()


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct tokens of a text. Words are what ASCII white space separates, A-Z in lower case.

    With fewer than five words their whole sequence is the only token; without words there is none.
    """
    words = _hashes.of((text or "").encode("utf-8", "surrogatepass").lower().split())
    if 0 < len(words) < SHINGLE:
        return shingle_hashes(words, len(words)) ^ np.uint64(len(words))
    return np.unique(shingle_hashes(words, SHINGLE))


def needed(n: int) -> int:
    """The least number of tokens that a set of ``n`` shares with a similar one."""
    return -(-PERCENT * n // 100)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def pack(numbers: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as byte planes of their differences, which compress well."""
    return np.diff(numbers, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def announce(bits: int, chunk: pd.DataFrame) -> pd.DataFrame:
    """The chunk's distinct tokens by range, with the number of its documents that have each."""
    sets = [shingle_set(t if isinstance(t, str) else None) for t in chunk["text"]]
    every = np.concatenate([*sets, np.zeros(0, np.uint64)]) >> np.uint64(32 - bits)
    keys, counts = np.unique(every, return_counts=True)
    ranges = (keys >> np.uint64(32)).astype(np.int64)
    at, first = np.unique(ranges, return_index=True)
    last = np.append(first[1:], len(keys))
    low = keys.astype(np.uint32)
    return pd.DataFrame({
        "range": at.astype(np.int32), "chunk": np.int32(chunk["chunk"].iloc[0]),
        "tokens": [pack(low[a:b]) for a, b in zip(first, last, strict=True)],
        "counts": [np.minimum(counts[a:b], 65535).astype("<u2").tobytes() for a, b in zip(first, last, strict=True)],
    })


def count_range(announced: pd.DataFrame) -> pd.DataFrame:
    """To every chunk: which of its tokens occur in two documents or more, and in how many (up to 65,535)."""
    announced = announced.sort_values("chunk", kind="stable")
    parts = [unpack(t) for t in announced["tokens"]]
    counts = np.concatenate([np.frombuffer(c, "<u2") for c in announced["counts"]])
    distinct, number = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.minimum(np.bincount(number, counts, len(distinct)), 65535).astype("<u2")
    of_each = np.split(total[number], np.cumsum([len(p) for p in parts])[:-1])
    shared = [d >= 2 for d in of_each]
    return pd.DataFrame({
        "chunk": announced["chunk"].to_numpy(), "range": announced["range"].to_numpy(),
        "tokens": [pack(p[s]) for p, s in zip(parts, shared, strict=True)],
        "counts": [d[s].tobytes() for d, s in zip(of_each, shared, strict=True)],
    })


SELECTED = (
    "doc_id bigint, n bigint, copies bigint, set1 bigint, set2 bigint, tokens binary, alone bigint, weight double, "
    "prefix_a array<bigint>, prefix_b binary"
)


def select(bits: int, chunk: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
    """A row per document; those with enough shared tokens to be similar to another get set hashes and prefixes.

    ``alone`` tokens stand before the prefix in every order, as no other document has them; ``weight`` is the mean
    document frequency of all tokens: of near copies of one text, that text has the most. Of documents with equal sets in the chunk only the one with the least id carries them.
    """
    back = back.sort_values("range", kind="stable")
    keys = np.concatenate([
        (np.uint64(r) << np.uint64(32)) | unpack(t).astype(np.uint64) for r, t in zip(back["range"], back["tokens"], strict=True)
    ] + [np.zeros(0, np.uint64)])
    counts = np.concatenate([np.frombuffer(c, "<u2") for c in back["counts"]] + [np.zeros(0, np.uint16)])
    rows, carried = [], set()
    chunk = chunk.sort_values("doc_id", kind="stable")
    for doc_id, text, copies in zip(chunk["doc_id"].tolist(), chunk["text"], chunk["copies"].tolist(), strict=True):
        known = not pd.isna(doc_id)
        mine = shingle_set(text if isinstance(text, str) else None)
        n = len(mine)
        row = [int(doc_id) if known else None, n, copies] + [None] * 7
        rows.append(row)
        if not known or not n or not len(keys):
            continue
        own = mine >> np.uint64(32 - bits)
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        shared = keys[at] == own
        alone = n - int(shared.sum())
        if n - alone < needed(n):
            continue
        row[3:5] = _signed(mix(mine + SET_1).sum(dtype=np.uint64)), _signed(mix(mine + SET_2).sum(dtype=np.uint64))
        if (row[3], row[4]) in carried:
            continue
        carried.add((row[3], row[4]))
        tokens, often = mine[shared], counts[at[shared]]
        length = n - needed(n) + 1 - alone
        a, b = (tokens[np.lexsort((mix(tokens ^ order), often))[:length]] for order in (ORDER_A, ORDER_B))
        row[5:] = mine.tobytes(), alone, (alone + int(often.sum(dtype=np.int64))) / n, a.view(np.int64), b.tobytes()
    made = pd.DataFrame(rows, columns=["doc_id", "n", "copies", "set1", "set2", "tokens", "alone", "weight", "prefix_a", "prefix_b"], dtype=object)
    return made.astype({c: "Int64" for c in ("doc_id", "n", "copies", "set1", "set2", "alone")} | {"weight": "Float64"})


def _signed(x: np.uint64) -> int:
    return int(np.uint64(x).astype(np.int64))


def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs that pass the filters of the other orders and are similar."""
    for batch in batches:
        kept = []
        for x, y, b, c in zip(*(batch[name] for name in ("x_tokens", "y_tokens", "x_prefix", "y_prefix")), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shares_b = len(np.intersect1d(np.frombuffer(b, np.uint64), np.frombuffer(c, np.uint64), assume_unique=True)) > 0
            kept.append(shares_b and len(np.intersect1d(_first_c(x), _first_c(y), assume_unique=True)) > 0 and similar(x, y))
        yield batch.loc[np.array(kept, bool), ["x", "y"]]


def _first_c(tokens: np.ndarray) -> np.ndarray:
    """The prefix under the third order, by a hash alone."""
    ranked = mix(tokens ^ ORDER_C)
    length = len(tokens) - needed(len(tokens)) + 1
    return ranked[np.argpartition(ranked, length - 1)[:length]]


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, comp``: the least node of each one's component, given ``comp`` labels so far and edges ``x, y``.

    Labels spread over edges and jump to their label's label, until none changes; each round is a written table.
    """
    both = edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    labels, both = nodes, stored(both, "links")
    while True:
        near = both.join(labels, F.col("x") == F.col("node")).groupBy("y").agg(F.min("comp").alias("_near"))
        lower = labels.join(near, F.col("node") == F.col("y"), "left").select(
            "node", F.col("comp").alias("_was"), F.least("comp", F.coalesce("_near", "comp")).alias("comp")
        )
        jump = lower.select(F.col("node").alias("_n"), F.col("comp").alias("_up"))
        fresh_labels = stored(
            lower.join(jump, F.col("comp") == F.col("_n"), "left").select("node", "_was", F.least("comp", F.coalesce("_up", "comp")).alias("comp")),
            "labels",
        )
        if not fresh_labels.filter("comp < _was").limit(1).count():
            return fresh_labels.select("node", "comp")
        labels = fresh_labels.select("node", "comp")


def rows_once(read: DataFrame) -> tuple[DataFrame, bool]:
    """Each row of ``doc_id, text`` once, with how often it stands in the table as ``copies``, and whether any does twice.

    Rows are counted by a hash, so that only repeated ones travel with their texts, and those pre-aggregated.
    """
    marked = read.withColumn("_digest", F.xxhash64("doc_id", "text"))
    counted = marked.groupBy("_digest").agg(F.count(F.lit(1)).alias("_rows"))
    repeated = stored(counted.filter("_rows > 1").select("_digest"), "repeated")
    if not repeated.limit(1).count():
        return read.withColumn("copies", F.lit(1).cast("bigint")), False
    once = without_match(marked, repeated, ["_digest"]).select("doc_id", "text", F.lit(1).cast("bigint").alias("copies"))
    often = lookup(marked, repeated, ["_digest"], "inner").groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    return once.unionByName(often), True


def repeat_rows(df: DataFrame) -> DataFrame:
    """Each row ``copies`` times, in steps of bounded size."""
    steps = F.explode(F.expr(f"sequence(0L, (copies - 1) DIV {REPEAT_ROWS})"))
    turns = F.explode(F.expr(f"sequence(1L, least({REPEAT_ROWS}L, copies - _step * {REPEAT_ROWS}))"))
    return df.withColumn("_step", steps).withColumn("_turn", turns).drop("_step", "_turn", "copies")


def all_within(placed: DataFrame, other: list[Column]) -> DataFrame:
    """Every two nodes of a token; those of a token with many rows are dealt to several tasks."""
    slices = placed.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int").alias("slices"))
    sliced = stored(lookup(placed, slices, ["token"], "inner"), "sliced")
    mine = sliced.withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")).drop("slices")
    others = sliced.select("token", *other, F.explode(F.expr("sequence(0, slices - 1)")).alias("slice"))
    return mine.join(others, ["token", "slice"]).filter("node < h_node")


def join_similar(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``, the least id reachable over links.

    Two documents are linked from similarity 0.8 of their sets of five-word shingles. Null and empty texts have no
    shingle and no link; rows without an id get ``n_shingles`` and a null component; repeated rows each
    get their row; rows that share an id are one document that is linked where any of its texts is; other columns
    are ignored. Links within a component aren't enumerated: pairs already in one component aren't verified.
    """
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chars = read.agg(F.sum(F.length("text"))).first()[0] or 0
    # Blocks are chunks times ranges; larger ones keep their number from growing with the square of the corpus.
    grown = min(GROWN, max(1, chars // (BLOCK_SIDES * CHUNK_CHARS)))
    chunks = max(1, -(-chars // (CHUNK_CHARS * grown)))
    bits = max(0, (max(1, -(-chars // (RANGE_CHARS * grown))) - 1).bit_length())
    rows, repeats = rows_once(read)
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")).repartition("chunk")
    announced = dealt.groupBy("chunk").applyInPandas(
        lambda chunk: announce(bits, chunk), "range int, chunk int, tokens binary, counts binary"
    )
    back = announced.groupBy("range").applyInPandas(count_range, "chunk int, range int, tokens binary, counts binary")
    selected = stored(
        dealt.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(lambda c, b: select(bits, c, b), SELECTED), "selected"
    )
    found = selected.filter("set1 IS NOT NULL")
    classes = stored(found.groupBy("set1", "set2").agg(F.min("doc_id").alias("node")), "classes")
    carriers = found.filter("tokens IS NOT NULL").join(classes, ["set1", "set2"]).filter("doc_id = node")
    # What is left of the set from each prefix token on bounds the overlap of pairs that have it first in common.
    grams = carriers.select("node", "n", "alone", "weight", F.posexplode("prefix_a").alias("at", "token"))
    grams = stored(grams.select("node", "n", "weight", "token", (F.col("n") - F.col("alone") - F.col("at")).alias("left")), "prefixes")
    sets = found.filter("tokens IS NOT NULL").select("doc_id", "tokens", "prefix_b")

    def check(pairs: DataFrame) -> DataFrame:
        # Only the sets of these pairs travel.
        ends = stored(pairs.select("x").union(pairs.select("y")).distinct(), "ends")
        asked = sets.join(ends, F.col("doc_id") == F.col("x"), "left_semi")
        for end in ("x", "y"):
            side = asked.select(F.col("doc_id").alias(end), F.col("tokens").alias(f"{end}_tokens"), F.col("prefix_b").alias(f"{end}_prefix"))
            pairs = pairs.join(side, end)
        return stored(pairs.mapInPandas(verify, "x bigint, y bigint"), "similar")

    comp = classes.select("node", F.col("node").alias("comp")).distinct()
    # An id with several texts ties their nodes together.
    member = lookup(found.select("doc_id", "set1", "set2"), classes, ["set1", "set2"], "inner").select("doc_id", "node").distinct()
    several = member.groupBy("doc_id").agg(F.min("node").alias("x"), F.max("node").alias("_most")).filter("x != _most")
    ties = stored(member.join(several, "doc_id").filter("node != x").select("x", F.col("node").alias("y")), "ties")
    placed = grams.withColumn("comp", F.col("node"))
    if ties.limit(1).count():
        comp = components(comp, ties)
        placed = grams.join(comp, "node")
    tested = spark.createDataFrame([], "x bigint, y bigint")
    hubs = spark.createDataFrame([], "node bigint")
    for turn in range(STAR_ROUNDS + 1):
        other = [F.col(c).alias(f"h_{c}") for c in ("node", "n", "left", "comp")]
        if turn < STAR_ROUNDS:
            # The member nearest to the middle of its group that hasn't been the group's hub.
            free = placed if not turn else placed.join(hubs, "node", "left_anti")
            hub = free.groupBy("token").agg(F.max(F.struct("weight", "node", "n", "left", "comp")).alias("hub")).select("token", "hub.*")
            hub = stored(hub, "hubs")
            met = lookup(placed, hub.select("token", *other), ["token"], "inner")
            if turn + 1 < STAR_ROUNDS:
                hubs = hubs.union(hub.select("node").distinct())
        else:
            met = all_within(placed, other)
        pairs = met.filter(
            f"comp != h_comp AND 100 * least(n, h_n) >= {PERCENT} * greatest(n, h_n)"
            f" AND {100 + PERCENT} * least(left, h_left) >= {PERCENT} * (n + h_n)"
        ).select(F.least("node", "h_node").alias("x"), F.greatest("node", "h_node").alias("y")).distinct()
        pairs = stored(pairs.join(tested, ["x", "y"], "left_anti"), "pairs")
        if pairs.limit(1).count():
            comp = components(comp, check(pairs))
            tested = tested.unionByName(pairs)
        if turn < STAR_ROUNDS:
            # Only groups that are still apart go on.
            again = placed.drop("comp").join(comp, "node")
            apart = again.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least != most")
            placed = stored(lookup(again, stored(apart.select("token"), "apart-tokens"), ["token"], "inner"), "apart")
    of_set = stored(classes.join(comp, "node").select("set1", "set2", "comp"), "sets")
    # Documents without a similar one have no set hashes: they are set aside, and sets of many documents split.
    alone, shared = selected.filter("set1 IS NULL"), selected.filter("set1 IS NOT NULL")
    linked = lookup(shared.select("doc_id", "n", "copies", "set1", "set2"), of_set, ["set1", "set2"])
    linked = linked.select("doc_id", "n", "copies", "comp").unionByName(
        alone.select("doc_id", "n", "copies", F.lit(None).cast("bigint").alias("comp"))
    )
    if repeats:
        linked = repeat_rows(linked)
    shown = linked.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))
    again = selected.groupBy("doc_id").count().filter("doc_id IS NOT NULL AND count > 1")
    if not again.limit(1).count():
        return shown
    # Rows that share an id are one document, whichever of its texts is linked.
    least = shown.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("_least"))
    return shown.join(least, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("_least", "component_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group of linked documents the one with the least id, with all its columns; rows without an id stay.

    Of rows that share an id one stays.
    """
    names = docs.columns
    away = join_similar(docs).filter("component_id != doc_id").select("doc_id").distinct()
    kept = docs.join(away.withColumnRenamed("doc_id", "_away"), F.col("doc_id") == F.col("_away"), "left_anti")
    own = fresh(names, "_row")
    kept = kept.withColumn(own, F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    return kept.dropDuplicates(["doc_id", own]).select(*[F.col(f"`{c}`") for c in names])


#: Tables without null or repeated ids. Sets meet over a shared shingle.
ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13),
    'abcdefghijklmnopqrstuvwxyz     '), ' '), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
h AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
e AS (SELECT x, y FROM h UNION ALL SELECT y, x FROM h),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.y) AS component_id FROM n JOIN r ON r.x = n.doc_id GROUP BY n.doc_id, n.n
"""
