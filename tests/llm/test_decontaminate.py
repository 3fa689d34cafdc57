import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from helpers import collected, documents

from rowloom.llm import decontaminate as D


def shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def alike(a, b):
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


def brute(docs, items):
    """Best similarity of each document's windows of the item's size to each item, where it is 0.8 or more."""
    out = {}
    for d, text in docs:
        words = re.findall(r"\w+", (text or "").lower())
        for i, item in items:
            item = re.findall(r"\w+", item.lower())
            if len(item) < 5:
                continue
            best = 0
            for start in range(5 - len(item), len(words) - 4):
                window = words[max(0, start) : start + len(item)]
                if len(window) >= 5:
                    best = max(best, alike(shingles(window), shingles(item)))
            if best >= 0.8:
                out[d, i] = round(best, 9)
    return out


@pytest.fixture(scope="module")
def planted():
    draw = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(draw.choice(words) for _ in range(draw.randint(12, 70)))) for k in range(15)]
    items += [(100, "four words only here"), (101, "a a a a a a a a a a b c d e f g a a a a a a")]
    docs = []
    for d in range(90):
        body = [draw.choice(words) for _ in range(draw.randint(0, 60))]
        if draw.random() < 0.7:
            item = draw.choice(items)[1].split()
            for _ in range(draw.randint(0, 2)):
                kind, at = draw.random(), draw.randrange(len(item))
                item[at : at + 1] = [] if kind < 0.3 else [draw.choice(words)] * (1 if kind < 0.7 else 2)
            if draw.random() < 0.3:
                item = item[draw.randint(0, 3) : len(item) - draw.randint(0, 3)]
            at = draw.randint(0, len(body))
            body[at:at] = [w.upper() if draw.random() < 0.2 else w for w in item]
        docs.append((d, ", ".join(body)))
    return docs, items


def test_as_brute_force(spark, planted):
    docs, items = planted
    got = D.contaminated(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got.collect()} == brute(docs, items)
    assert brute(docs, items)


def test_parts_of_documents_and_of_the_benchmark(spark, planted, monkeypatch):
    docs, items = planted
    table = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(collected(D.contaminated(documents(spark, docs), table)))
    monkeypatch.setattr(D, "PASS_WORDS", 60)
    assert sorted(collected(D.contaminated(documents(spark, docs), table))) == whole
    kept = D.drop_contaminated(documents(spark, docs, clashing=True), table)
    assert kept.columns == documents(spark, docs, clashing=True).columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {r[0] for r in whole}


def test_long_text_in_pieces(planted, monkeypatch):
    _, items = planted
    item = items[0][1]
    found = [(i, D.word_hashes(t)) for i, t in items]
    found = [(i, w) for i, w in found if len(w) >= 5]
    import numpy as np

    benchmark = D.Benchmark([i for i, _ in found], np.array([len(w) for _, w in found]), [D.shingle_hashes(w, 5) for _, w in found])
    text = " ".join(f"z{k}" for k in range(5000)) + " " + item + " " + " ".join(f"y{k}" for k in range(500))
    whole = D.matches(benchmark, [text, None, "", item])
    monkeypatch.setattr(D, "CHUNK_CHARS", 700)
    assert D.matches(benchmark, [text, None, "", item]) == whole
    assert [m["first_word"] for m in whole[0]] == [5000] and whole[1] == whole[2] == [] and len(whole[3]) == 1


def test_defined_cases(spark):
    item = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, item), (2, item), (None, item + " eleven twelve"), (3, None), (4, "")], "item_id long, text string")
    docs = documents(spark, [(1, item), (1, item), (None, f"x {item} y"), (2, None), (3, ""), (4, "one two three")], clashing=True)
    got = sorted(((r.doc_id, r.item_id, round(r.similarity, 3)) for r in D.contaminated(docs, items).collect()), key=str)
    assert got.count((1, 1, 1.0)) == 2 and (None, 2, 1.0) in got and not any(r[0] in (2, 3, 4) for r in got)
    empty = items.limit(0)
    assert D.contaminated(docs, empty).count() == 0 and D.drop_contaminated(docs, empty).count() == 6
    assert D.contaminated(documents(spark, []), items).count() == 0


def loaded(items):
    found = [(i, D.word_hashes(t)) for i, t in items]
    return D.Benchmark([i for i, _ in found], np.array([len(w) for _, w in found]), [D.shingle_hashes(w, 5) for _, w in found])


@pytest.mark.parametrize("n", [40, 6000])
def test_block_tables_find_all_within_the_radius(n, monkeypatch):
    """Few items go through the values held, many through the values around."""
    monkeypatch.setattr(D, "SLICE_PAIRS", 50_000)
    draw = np.random.default_rng(n)
    bits = draw.integers(0, 2, (n, D.BITS), np.uint8)
    bits[: n // 4] = bits[0]
    asked = bits[draw.integers(0, n, 300)]
    for row in asked:
        row[draw.choice(D.BITS, draw.integers(0, 60), replace=False)] ^= 1
    index = D.SizeIndex(np.arange(n) * 3, np.packbits(bits, axis=1).view(np.uint16))
    assert (index.tables[0].place is None) == (n == 40)
    apart = (asked[:, None, :] != bits[None]).sum(axis=2)
    expect = [(w, 3 * i) for w, i in zip(*np.nonzero(apart <= D.RADIUS), strict=True)]
    assert [(w, i) for rows, items in index.near(np.packbits(asked, axis=1).view(np.uint16)) for w, i in zip(rows, items, strict=True)] == expect
    assert len(set(apart[apart <= D.RADIUS])) > 20


def test_one_size_and_one_shingle_in_most_items():
    """Memory doesn't grow with windows times items of a size, nor with places times items of a shingle."""
    draw, words = random.Random(11), [f"w{k}" for k in range(5000)]
    start = "what is the right answer"
    items = [(k, " ".join([start, *(draw.choice(words) for _ in range(35))])) for k in range(12_000)]
    text = " ".join(f"{start} {draw.choice(words)}" for _ in range(600)) + " " + items[77][1]
    benchmark = loaded(items)
    D.matches(benchmark, [items[5][1]])
    tracemalloc.start()
    try:
        got = D.matches(benchmark, [text])
        assert tracemalloc.get_traced_memory()[1] < 150 << 20
    finally:
        tracemalloc.stop()
    assert [(m["item_id"], m["similarity"], m["first_word"], m["n_words"]) for m in got[0]] == [(77, 1.0, 3600, 40)]


def test_long_item_in_slices_of_votes(monkeypatch):
    draw = random.Random(2)
    item = " ".join(f"w{draw.randrange(900)}" for _ in range(700))
    text = "x y z " * 40 + item + " v w" * 60
    whole = D.matches(loaded([(1, item)]), [text])
    monkeypatch.setattr(D, "SLICE_VOTES", 64)
    assert D.matches(loaded([(1, item)]), [text]) == whole and whole[0][0]["first_word"] == 120
