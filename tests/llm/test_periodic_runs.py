import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import FOLDER, collected, documents

from rowloom.llm import periodic_runs as P


def brute_runs(words):
    """Every stretch in which words a period apart are equal, for every period; the smallest period of each stays."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q - start), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def split(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def brute(doc_id, text):
    words = split(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone))]
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha)


def lyndon(s):
    n = len(s)
    return [max(j - i for j in range(i + 1, n + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j))) for i in range(n)]


def test_lyndon_array_as_brute_force():
    draw = random.Random(1)
    for _ in range(600):
        s = [draw.randrange(draw.randint(1, 4)) for _ in range(draw.randint(1, 14))]
        ranks = np.unique(s, return_inverse=True)[1]
        assert P.lyndon_array(ranks).tolist() == lyndon(ranks.tolist())
    assert P.lyndon_array(np.zeros(0, np.int64)).tolist() == []


def made(draw):
    words = []
    for _ in range(draw.randint(0, 6)):
        block = [f"w{draw.randrange(3)}" for _ in range(draw.randint(1, 6))]
        words += block * draw.randint(1, 7)
    return draw.choice([" ", "\t", " \n", "\x0b"]).join(words)


def test_runs_as_brute_force(spark):
    draw = random.Random(2)
    rows = [(i, made(draw)) for i in range(500)]
    got = {r.doc_id: r for r in P.find_runs(documents(spark, rows)).collect()}
    for doc_id, text in rows:
        words, runs = split(text), brute_runs(split(text))
        assert [tuple(r) for r in got[doc_id].runs] == runs and got[doc_id].n_words == len(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        assert got[doc_id].collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_query_as_brute_force(spark):
    """The given documents, most of them looked at in one batch, and made ones."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = sorted(collected(P.run_digest(P.with_repeated_tails(docs))))
    assert got == sorted(brute(r.doc_id, r.text) for r in docs.collect())
    assert any(r[1] for r in got)
    draw = random.Random(3)
    rows = [(i, made(draw)) for i in range(400)]
    assert sorted(collected(P.run_digest(P.with_repeated_tails(documents(spark, rows))))) == sorted(brute(*r) for r in rows)


def test_defined_cases(spark):
    ten = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(None, "a b " * 9), (None, None), (7, None), (8, ""), (9, "a a a a a"), (9, "a a a a a"), (ten, "one"), (ten, ""), (ten, None), (-5, "x " * 6), (-5, "é \U0001f600 " * 5)]
    df = documents(spark, rows, clashing=True)
    got = sorted(collected(P.run_digest(P.with_repeated_tails(df))), key=str)
    assert got == sorted((brute(*r) for r in rows), key=str)
    found = P.find_runs(df.selectExpr("*", "1 AS runs", "2 AS collapsed", "3 AS _found"))
    assert found.columns[-3:] == ["n_words", "_runs", "_collapsed"] and found.count() == len(rows)
    assert P.run_digest(documents(spark, [])).count() == 0


@pytest.mark.parametrize("words", [["a"] * 200_000, [f"w{i}" for i in range(40_000)] * 5, ["a", "b"] * 60_000 + ["a"] * 60_000])
def test_long_text(spark, words):
    """In time that grows with the text: one word, many words, nested runs."""
    found = P.find_runs(documents(spark, [(1, " ".join(words))])).first()
    assert [tuple(r) for r in found.runs] == {
        200_000: [(0, 200_000, 1)] if words[1] == "a" else [(0, 200_000, 40_000)], 180_000: [(0, 120_001, 2), (120_000, 60_000, 1)],
    }[len(words)]
