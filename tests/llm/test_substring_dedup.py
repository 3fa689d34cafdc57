import hashlib
import random
from collections import Counter

import pytest
from helpers import collected, documents, duck

from rowloom.llm import substring_dedup as S


def split(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def brute(rows):
    """All windows of all texts, counted by their words."""
    texts = [split(r[1]) for r in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    made = []
    for (doc_id, *_), words in zip(rows, texts, strict=True):
        gone = {k for i in range(len(words) - 34) if seen[tuple(words[i : i + 35])] > 1 for k in range(i, i + 35)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        made.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(made, key=str)


def made(seed, n=60):
    draw = random.Random(seed)
    shared = [[f"s{draw.randrange(50)}" for _ in range(length)] for length in (34, 35, 36, 52, 53, 120)]
    rows = []
    for i in range(n):
        words = [f"w{draw.randrange(2000)}" for _ in range(draw.randint(0, 150))]
        for _ in range(draw.randint(0, 3)):
            at = draw.randint(0, len(words))
            part = draw.choice(shared)
            cut = draw.choice([0, 0, 0, draw.randrange(len(part))])
            words[at:at] = part[cut:]
        if rows and draw.random() < 0.2:
            words = split(draw.choice(rows)[1])
        if draw.random() < 0.1:
            words += ["again", "and"] * draw.randint(1, 40)
        rows.append((i, draw.choice([" ", "\n", "\t "]).join(words)))
    return rows


def result(spark, rows, **more):
    return sorted(collected(S.substring_digest(documents(spark, rows, **more))), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_as_brute_force_and_sql(spark, seed):
    rows = made(seed)
    assert result(spark, rows) == brute(rows)
    assert sorted(duck(rows, S.ORACLE), key=str) == brute(rows)


def test_many_chunks_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_CHARS", 3_000)
    monkeypatch.setattr(S, "RANGE_WORDS", 100)
    rows = made(7, 120)
    assert result(spark, rows) == brute(rows)


def test_a_passage_in_a_third_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_CHARS", 20_000)
    draw = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    whole = " ".join(f"c{i}" for i in range(80))
    rows = [(i, whole if i % 3 == 0 else " ".join(f"w{draw.randrange(10**6)}" for _ in range(i % 50)) + f" {passage if i % 3 == 1 else i}") for i in range(600)]
    assert result(spark, rows) == brute(rows)


def test_defined_cases(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [
        (1, long), (1, long), (None, f"x {long}"), (None, None), (None, None), (4, None), (5, ""), (6, " ".join(f"w{i}" for i in range(34))),
        (7, "a " * 35), (8, "b " * 36), (9, "é \U0001f600"), (9, "é \U0001f600"), (9, "other"),
    ]
    assert result(spark, rows, clashing=True) == brute(rows)
    df = documents(spark, rows, clashing=True).selectExpr("*", "1 AS n_words", "2 AS row", "3 AS h1", "4 AS single")
    found = S.drop_substrings(df)
    assert found.columns == [*df.columns, "_n_words", "n_removed"]
    assert {(r.doc_id, r.lang, r.row, r.h1, r.n_words) for r in found.collect()} == {(r[0], "en", 2, 3, 1) for r in rows}
    assert all(r.text == "" for r in found.collect() if r._n_words == 0)
    assert S.drop_substrings(documents(spark, [])).count() == 0
    assert S.drop_substrings(documents(spark, [(1, long)]).select("text")).first().n_removed == 0


def test_long_text(spark):
    words = [f"w{i}" for i in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["x", *words[1000:290_000], "y"]))]
    got = {r.doc_id: r for r in S.drop_substrings(documents(spark, rows)).collect()}
    assert got[1].n_removed == got[2].n_removed == 289_000 and got[2].text == "x y"
    assert got[1].text == " ".join(words[:1000] + words[290_000:])
