import random

import numpy as np
import pytest
from helpers import collected, documents

from rowloom.llm import ngram_join as N


def tokens(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """Components by comparing all pairs."""
    sets = {i: tokens(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def made(seed, n=120):
    """Families of texts with edits of all sizes, chains of links, shared passages, copies."""
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [draw.choice(words) for _ in range(40)]
    rows, kept = [], []
    for i in range(n):
        kind = draw.random()
        if kept and kind < 0.5:
            text = list(draw.choice(kept))
            for _ in range(draw.randint(0, 3)):
                text[draw.randrange(len(text))] = draw.choice(words)
        elif kind < 0.7:
            text = [draw.choice(words) for _ in range(draw.randint(5, 60))] + passage
        else:
            text = [draw.choice(words) for _ in range(draw.randint(1, 120))]
        kept.append(text)
        rows.append((i * 7 % 1009, " ".join(w.upper() if draw.random() < 0.05 else w for w in text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_as_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(N, "CHUNK_CHARS", 4_000)
    monkeypatch.setattr(N, "RANGE_CHARS", 5_000)
    rows = made(seed)
    assert sorted(collected(N.join_similar(documents(spark, rows)))) == brute(rows)


def test_large_group_of_near_copies_and_common_passage(spark):
    draw = random.Random(5)
    base = [f"b{k}" for k in range(150)]
    passage = " ".join(f"p{k}" for k in range(60))
    rows = []
    for i in range(150):
        text = list(base)
        text[draw.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(f"u{i}_{k}" for k in range(30)) + " " + passage) for i in range(100)]
    assert sorted(collected(N.join_similar(documents(spark, rows)))) == brute(rows)


def test_defined_cases(spark):
    rows = [
        (1, "a b c d e f g"), (2, "A B\tC\nd e f g"), (3, ""), (4, None), (5, "x y"), (6, "X  Y"), (7, "y x"), (None, "a b c d e f g"),
        (8, "only once here"), (8, "a b c d e f g"), (9, "only once here"), (10, "q\xa0r s"), (11, "   "),
    ]
    got = sorted(collected(N.join_similar(documents(spark, rows, clashing=True))), key=str)
    expect = [(1, 3, 1), (2, 3, 1), (3, 0, 3), (4, 0, 4), (5, 1, 5), (6, 1, 5), (7, 1, 7), (None, 3, None), (8, 1, 1), (8, 3, 1), (9, 1, 1), (10, 1, 10), (11, 0, 11)]
    assert got == sorted(expect, key=str)
    assert collected(N.join_similar(documents(spark, []))) == []


def test_rows_without_id_and_repeated_rows_in_many(spark, monkeypatch):
    """A third of the rows has no id, a third is one row, nothing is broadcast and every slice is short."""
    monkeypatch.setattr(N, "SLICE_ROWS", 3)
    monkeypatch.setattr(N, "REPEAT_ROWS", 100)
    monkeypatch.setattr("rowloom.plans.joins.is_small", lambda df: False)
    rows = made(3, 60)
    more = [(None, None)] * 350 + [(None, "a b c d e f g h")] * 350 + [rows[5]] * 650
    got = collected(N.join_similar(documents(spark, rows + more).repartition(7)))
    expect = brute(rows)
    mine = next(r for r in expect if r[0] == rows[5][0])
    assert sorted(got, key=str) == sorted(expect + [(None, 0, None)] * 350 + [(None, 4, None)] * 350 + [mine] * 650, key=str)


def test_blocks_grow_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(N, "CHUNK_CHARS", 500)
    monkeypatch.setattr(N, "RANGE_CHARS", 500)
    monkeypatch.setattr(N, "BLOCK_SIDES", 4)
    rows = made(4, 80)
    assert sorted(collected(N.join_similar(documents(spark, rows)))) == brute(rows)


def test_keep_one(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "other words are here now"), (None, "a b c d e f"), (None, None)]
    kept = N.keep_one(documents(spark, rows, clashing=True))
    assert kept.columns == documents(spark, rows, clashing=True).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "a b c d e f"), (2, "other words are here now"), (None, "a b c d e f"), (None, None)], key=str)


def test_packing():
    numbers = np.unique(np.random.default_rng(1).integers(0, 1 << 32, 5000, dtype=np.uint32))
    assert (N.unpack(N.pack(numbers)) == numbers).all()
    assert len(N.unpack(N.pack(numbers[:0]))) == 0
