import itertools
import random

import duckdb
from helpers import documents
from pyspark.sql import functions as F

from rowloom.llm import filter_audit as A

LABELS = "doc_id long, quality int, toxic int"


def failing(rows):
    """The letters each row fails, by comparing every text with every other."""
    made = []
    for doc_id, text, *_ in rows:
        t = text or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        fails = set()
        if len(words) < 50:
            fails.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t):
            fails.add("C")
        if any(c in "#$%&*|" for c in t):
            fails.add("D")
        if doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == t for o in rows):
            fails.add("E")
        made.append(fails)
    return made


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    made, fails = set(), failing(rows)
    parts = {(r[3] if len(r) > 2 else "web") or "" for r in rows}
    for part in parts:
        mine = [(r[0], f) for r, f in zip(rows, fails, strict=True) if ((r[3] if len(r) > 2 else "web") or "") == part]
        lines, total = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, x in enumerate(order, 1):
                out = [m for m in left if x in m[1]]
                gone = [m for m in mine if m not in left]
                redundant = sum(x in f for _, f in mine) - len(out)
                left = [m for m in left if x not in m[1]]
                total[x] += len(out)
                lines.append((
                    "".join(order), step, len(left), len(out), redundant, sum(f == {x} for _, f in mine),
                    sum(d in good for d, _ in out), sum(d in toxic for d, _ in out), x,
                ))
                assert len(gone) + len(out) + len(left) == len(mine)
        made |= {(part, *line[:8], total[line[8]]) for line in lines}
    return made


def made(seed, clash=False):
    draw = random.Random(seed)
    pool = [" ".join(f"{draw.choice('aB#')}{draw.randrange(40)}" if draw.random() < 0.2 else f"w{draw.randrange(90)}" for _ in range(n)) for n in (3, 50, 49, 51, 70, 200)]
    rows = [(draw.choice([i, i, i, None, 5]), draw.choice([*pool, *pool, None, "", f"only {i}\tA\x0bB"]), "en", draw.choice(["a", "a", "a", None, ""])) for i in range(50)]
    labels = [(draw.choice([draw.randrange(50), None]), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(40)]
    return rows, labels


def result(spark, rows, labels, **more):
    got = A.audit_filters(documents(spark, rows, clashing=True), spark.createDataFrame(labels, LABELS), **more).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def test_as_brute_force(spark):
    rows, labels = made(1)
    assert result(spark, rows, labels) == brute(rows, labels)


def test_hashes_that_texts_share(spark):
    """With a hash that many texts share, the full text decides; the sketch clears nothing it shouldn't."""
    rows, labels = made(2)
    assert result(spark, rows, labels, hash_of=lambda text: F.length(text).cast("bigint") % 3) == brute(rows, labels)


def test_a_sketch_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(A, "SKETCH_BYTES", 0)
    rows, labels = made(3)
    assert result(spark, rows, labels) == brute(rows, labels)


def test_sketch_clears_only_what_is_unique(spark):
    hashes = spark.range(30000).select(F.xxhash64((F.col("id") % 25000).cast("string")).alias("hash"), "id")
    sketch, blocks = A.repeat_sketch(hashes.select("hash"), 30000)
    left = {r.id for r in A.probe(hashes, sketch, blocks).collect()}
    twice = {*range(5000), *range(25000, 30000)}
    assert twice <= left and len(left - twice) < 500


def test_one_text_in_a_third_of_all_rows(spark):
    rows = [(i, "the same words again" if i % 3 == 0 else f"word {i}", "en", "web") for i in range(1, 400)]
    flags = {r.doc_id: r.mask for r in A.flag_documents(documents(spark, rows)).collect()}
    assert {d for d, m in flags.items() if m & 16} == {d for d, *_ in rows if d % 3 == 0 and d > 3}


def test_empty_and_sql_twin(spark):
    none = spark.createDataFrame([], LABELS)
    assert A.audit_filters(documents(spark, []), none).count() == 0
    rows, labels = made(4)
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    connection = duckdb.connect()
    connection.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    connection.sql("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    connection.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    connection.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    assert set(connection.sql(A.ORACLE).fetchall()) == result(spark, rows, labels)
