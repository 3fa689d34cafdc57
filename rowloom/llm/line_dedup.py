"""Line dedup: repeated runs of lines by prefix doubling over line-ID sequences, in DataFrame expressions only.

Every line gets a 128-bit ID. The run of 2**(k+1) lines from a place is named by the names of the two runs
of 2**k lines in it, so equal names are equal runs: they are the intervals of suffixes with that much
prefix in common. Doubling happens inside the row. Of each place the shortest run with enough words that
begins there and the one that ends there are looked up in the whole corpus, and all but the first of equal
runs are deleted. These runs together cover exactly the maximal repeated runs with enough words: a line
of such a run that isn't in the shortest run from its beginning has enough words before it, and then it
ends a shortest run inside it. As lines have a word at least, doubling ends after log2(words) steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import fresh, stored

#: A repeated run is deleted from its second occurrence on if it has so many words.
MIN_WORDS = 50


def _levels(min_words: int) -> int:
    return max(1, min_words.bit_length())


BLANKS = "trim(BOTH ' \\t\\r' FROM {})"


def _identity(docs: DataFrame, text: str) -> tuple[Column, Column, Column]:
    """Of a row: whether its id is null, the id, and a hash of its text; in this order rows come first or later."""
    return (
        docs["doc_id"].isNull(), F.coalesce(docs["doc_id"].cast("bigint"), F.lit(0).cast("bigint")),
        F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))),
    )


def _lines(docs: DataFrame, text: str) -> DataFrame:
    """Identity and ``_ls``: the texts of lines that aren't blank, without blanks around them."""
    nid, own, digest = _identity(docs, text)
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    return docs.select(nid.alias("_nid"), own.alias("_id"), digest.alias("_hash"), body.alias("_text")).withColumn(
        "_ls", F.expr(f"filter(transform(split(_text, '\\n'), l -> {BLANKS.format('l')}), t -> t != '')")
    )


def run_windows(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """The shortest runs with enough words: ``_nid, _id, _hash, start, len, key1, key2``; starts count lines that aren't blank."""
    top = _levels(min_words)
    made = _lines(docs, text).select(
        "_nid", "_id", "_hash", F.size("_ls").alias("_n"),
        F.expr("transform(_ls, t -> xxhash64(t))").alias("a0"), F.expr("transform(_ls, t -> xxhash64(11L, t))").alias("b0"),
        F.expr("transform(_ls, t -> CAST(regexp_count(t, '[^ \\\\t\\\\r]+') AS BIGINT))").alias("s0"),
    )
    for k in range(1, top):
        half, at = 1 << (k - 1), k - 1
        double = "transform(IF(_n >= {w}, sequence(0, _n - {w}), array()), i -> {{}})".format(w=2 * half)
        made = made.withColumns({
            f"a{k}": F.expr(double.format(f"xxhash64(get(a{at}, i), get(a{at}, i + {half}))")),
            f"b{k}": F.expr(double.format(f"xxhash64(11L, get(b{at}, i), get(b{at}, i + {half}))")),
            f"s{k}": F.expr(double.format(f"get(s{at}, i) + get(s{at}, i + {half})")),
        })
    levels = {c: f"array({', '.join(f'{c}{k}' for k in range(top))})" for c in "abs"}
    made = made.select("_nid", "_id", "_hash", "_n", *[F.expr(levels[c]).alias(c) for c in "abs"])
    steps = f"array({', '.join(str(k) for k in reversed(range(top)))})"
    # From a place the run grows by ever smaller powers of two while it has too few words.
    ahead = (
        f"aggregate({steps}, named_struct('at', i, 'sum', 0L), (z, k) -> "
        f"IF(z.sum + get(get(s, k), z.at) < {min_words}, named_struct('at', z.at + shiftleft(1, k), 'sum', z.sum + get(get(s, k), z.at)), z), "
        "z -> z.at)"
    )
    back = (
        f"aggregate({steps}, named_struct('at', i, 'sum', 0L), (z, k) -> "
        f"IF(z.at - shiftleft(1, k) + 1 >= 0 AND z.sum + get(get(s, k), z.at - shiftleft(1, k) + 1) < {min_words}, "
        "named_struct('at', z.at - shiftleft(1, k), 'sum', z.sum + get(get(s, k), z.at - shiftleft(1, k) + 1)), z), z -> z.at)"
    )
    places = "IF(_n > 0, sequence(0, _n - 1), array())"
    packed = "shiftleft(CAST(r.start AS BIGINT), 32) + r.last"
    made = made.withColumn(
        "_runs",
        F.expr(
            # Start and last place as one number, so that equal runs are found by a hash set.
            f"transform(array_distinct(concat(transform(filter(transform({places}, i -> named_struct('start', i, 'last', {ahead})), r -> r.last < _n), r -> {packed}), "
            f"transform(filter(transform({places}, i -> named_struct('start', {back}, 'last', i)), r -> r.start >= 0), r -> {packed}))), "
            "x -> named_struct('start', CAST(shiftright(x, 32) AS INT), 'last', CAST(x & 4294967295L AS INT)))"
        ),
    )
    size = "(r.last - r.start + 1)"
    level = "CASE " + " ".join(f"WHEN {size} >= {1 << k} THEN {k}" for k in reversed(range(top))) + " END"
    named = made.select(
        "_nid", "_id", "_hash", "a", "b",
        F.expr(f"transform(_runs, r -> named_struct('start', r.start, 'len', {size}, 'k', {level}))").alias("_runs"),
    )
    key = "xxhash64({salt}, r.len, get(get({c}, r.k), r.start), get(get({c}, r.k), r.start + r.len - shiftleft(1, r.k)))"
    return named.select(
        "_nid", "_id", "_hash",
        F.explode(F.expr(
            "transform(_runs, r -> named_struct('start', r.start, 'len', r.len, "
            f"'key1', {key.format(salt='1L', c='a')}, 'key2', {key.format(salt='2L', c='b')}))"
        )).alias("r"),
    ).select("_nid", "_id", "_hash", "r.*")


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """Per document with repeated runs: ``_nid, _id, _hash, _gone``, the places of its lines to delete.

    Runs are all kept but those that stand first in the order of id, text hash and line; removing these by an
    anti join on key *and* place spreads a run that stands in a third of all documents over all tasks.
    """
    windows = stored(run_windows(docs, min_words, text), "line-runs")
    firsts = windows.groupBy("key1", "key2").agg(F.min(F.struct("_nid", "_id", "_hash", "start")).alias("f"))
    copies = windows.join(firsts.select("key1", "key2", "f.*"), ["key1", "key2", "_nid", "_id", "_hash", "start"], "left_anti")
    return copies.groupBy("_nid", "_id", "_hash").agg(
        F.array_distinct(F.flatten(F.collect_list(F.expr("sequence(start, start + len - 1)")))).alias("_gone")
    )


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """The documents without later copies of repeated runs, all columns kept, plus ``n_lines`` and ``n_deleted``.

    Lines are compared without blanks around them; blank lines are not counted and stay. Order of occurrence: id, then
    text hash, then line; null ids come last. A run may repeat within a document. Null and empty texts stay as
    they are; repeated rows (same id and text) are one document and change alike; texts without deleted
    lines stay byte for byte. Where a new column's name is taken it gets a leading underscore.
    """
    names = docs.columns
    lines, gone = fresh(names, "n_lines"), fresh(names, "n_deleted")
    # The row as one column, so that none of its names can clash.
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"))
    body = F.col("row")[text].cast("string")
    found = later_copies(docs, min_words, text)
    own = F.col("row")["doc_id"]
    joined = rows.join(
        found,
        (own.isNull() == F.col("_nid")) & (F.coalesce(own.cast("bigint"), F.lit(0).cast("bigint")) == F.col("_id"))
        & (F.xxhash64(F.coalesce(body, F.lit(""))) == F.col("_hash")),
        "left",
    )
    # Places among the lines that aren't blank become line numbers; what isn't deleted is joined again. What is used twice isn't
    # moved into the function that uses it, where it would be made anew for every line.
    cut = (
        joined.withColumn("_all", F.when(F.col("_gone").isNotNull(), F.split(body, "\n")))
        .withColumn("_at", F.expr(f"filter(transform(_all, (l, i) -> IF({BLANKS.format('l')} != '', i, -1)), i -> i >= 0)"))
        .withColumn("_kept", F.expr("array_except(sequence(0, size(_all) - 1), transform(_gone, g -> IF(g < size(_at), get(_at, g), NULL)))"))
        .withColumn("_new", F.expr("array_join(transform(_kept, i -> get(_all, i)), '\\n')"))
    )
    new = F.when(F.col("_gone").isNull(), F.col("row")[text]).otherwise(F.col("_new"))
    count = F.regexp_count(body, F.lit(r"(?m)^[ \t\r]*[^ \t\r\n]"))
    return cut.select(
        *[(new if c == text else F.col("row")[c]).alias(c) for c in names],
        F.coalesce(count, F.lit(0)).cast("bigint").alias(lines),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("bigint").alias(gone),
    )


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without later copies, with their own columns; those of which nothing is left go.

    ``n_chars``, where the table has it, follows the text. Null and empty texts have no line and stay, as do texts
    of blanks; null ids come last in order; repeated rows change alike.
    """
    lines, gone = fresh(docs.columns, "n_lines"), fresh(docs.columns, "n_deleted")
    made = dedup_lines(docs, min_words).filter((F.col(gone) == 0) | (F.col(gone) < F.col(lines)))
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return made.select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same by text instead of hashes, for tables without null or repeated ids.
ORACLE = f"""
WITH l AS (
  SELECT doc_id, CAST(unnest(generate_series(1, len(string_split(text, chr(10))))) AS BIGINT) AS ln,
    trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS t FROM documents),
n AS (
  SELECT doc_id, ln, t, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS p,
    len(list_filter(string_split(replace(replace(t, chr(9), ' '), chr(13), ' '), ' '), lambda x: x <> '')) AS w FROM l WHERE t <> ''),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY p) AS upto FROM n),
fw AS (SELECT a.doc_id, a.p AS p1, min(b.p) AS p2 FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + {MIN_WORDS}
  AND b.upto - a.upto + a.w >= {MIN_WORDS} GROUP BY ALL),
bw AS (SELECT b.doc_id, max(a.p) AS p1, b.p AS p2 FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.p BETWEEN b.p - {MIN_WORDS} AND b.p
  AND b.upto - a.upto + a.w >= {MIN_WORDS} GROUP BY ALL),
r AS (SELECT * FROM fw UNION SELECT * FROM bw),
k AS (SELECT r.doc_id, r.p1, r.p2, string_agg(n.t, chr(10) ORDER BY n.p) AS run
  FROM r JOIN n ON r.doc_id = n.doc_id AND n.p BETWEEN r.p1 AND r.p2 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, p1) AS turn FROM k),
g AS (SELECT DISTINCT n.doc_id, n.ln FROM o JOIN n ON n.doc_id = o.doc_id AND n.p BETWEEN o.p1 AND o.p2 WHERE o.turn > 1),
x AS (
  SELECT l.doc_id, count(g.ln) AS gone, count(*) FILTER (WHERE l.t <> '') AS filled,
    string_agg(raw.t, chr(10) ORDER BY l.ln) FILTER (WHERE g.ln IS NULL) AS kept
  FROM l JOIN (SELECT doc_id, CAST(unnest(generate_series(1, len(string_split(text, chr(10))))) AS BIGINT) AS ln,
    unnest(string_split(text, chr(10))) AS t FROM documents) raw ON raw.doc_id = l.doc_id AND raw.ln = l.ln
  LEFT JOIN g ON g.doc_id = l.doc_id AND g.ln = l.ln GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN x.gone > 0 THEN coalesce(x.kept, '') ELSE d.text END AS text, d.lang, d.source, d.n_chars,
  CAST(x.filled AS BIGINT) AS n_lines, CAST(x.gone AS BIGINT) AS n_deleted
FROM documents d JOIN x ON x.doc_id = d.doc_id
"""
