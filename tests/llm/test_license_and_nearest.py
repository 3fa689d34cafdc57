import random
import re
import time

import numpy as np
import pytest
from helpers import collected, documents
from pyspark.sql import functions as F

from rowloom.llm import license_scan as L
from rowloom.llm import nearest as N


def base(text):
    words = re.findall(L.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at, labels = [], set()
    for phrase, label in L.BASE.items():
        phrase = phrase.split(" ")
        for i in range(len(words)):
            if words[i : i + len(phrase)] == phrase:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_phrases_as_brute_force(spark):
    draw = random.Random(1)
    bits = ["CC", "by", "cc-BY", "General", "public", "License", "general\npublic. license", "all", "rights", "RESERVED", "é", "x", "CC BY", "ccby", "K", "1", "_"]
    rows = [(i, draw.choice(["", " ", "(", "**"]).join(["", *[draw.choice(bits) + draw.choice([" ", "-", ", ", ""]) for _ in range(draw.randint(0, 14))]])) for i in range(300)]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.license_digest(documents(spark, rows)).collect()}
    assert got == {i: base(t) for i, t in rows}


def test_rules_fit_windows_gates_and_first_words():
    rules = L.rules()
    assert len(rules) > 500
    for word, pattern, _, _ in rules:
        # Any text of the rule, made by taking each option or leaving it out.
        for text in (re.sub(r"\(([^()]|\([^()]*\))*\)\?", "", pattern), pattern):
            text = re.sub(r"\[cs\]", "c", re.sub(r"\[\^[^\]]*\]\?", "e", text))
            text = re.sub(r"\[12\]\[0-9\]\{3\}", "2020", re.sub(r"\[a-z0-9 \]\{1,60\}", "x", text))
            text = re.sub(r"\[([0-9a-z])[0-9a-z]*\]", r"\1", text)
            text = re.sub(r"[()]|\|software ", "", text).replace("?", "")
            assert len(text.split()) < L.WINDOW
            assert any(g in text for g in L.GATES) or re.search(L.GATE_CC, text), pattern
        assert re.match(r"[a-z0-9]+$", word)


def test_detections(spark):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0."), (2, "Released under the MIT License."), (3, "uses zlib and mit words"),
        (4, "This work is licensed under the GNU General Public License, version 3. All rights reserved."), (5, "Licensed under CC BY-NC 4.0."),
        (6, "Permission is hereby granted, free of charge, to any person obtaining a copy"), (7, None), (8, ""), (None, "dedicated to the Public Domain"),
        (1, "Licensed under the Apache License, Version 2.0."),
    ]
    got = [(r.doc_id, r.labels, r.score) for r in L.license_digest(documents(spark, rows, clashing=True)).collect()]
    expect = [
        (1, "apache-2.0", 0.98), (2, "mit", 0.98), (3, "", 0.0), (4, "gpl,gpl-3.0,reserved", 0.98), (5, "cc-by,cc-by-nc", 0.98), (6, "mit", 0.9),
        (7, "", 0.0), (8, "", 0.0), (None, "public-domain", 0.9), (1, "apache-2.0", 0.98),
    ]
    assert sorted(got, key=str) == sorted(expect, key=str)
    found = {r.doc_id: r.found for r in L.scan_licenses(documents(spark, rows)).collect()}
    assert [(m.start, m.words, m.label) for m in found[1]] == [(0, 8, "apache-2.0")]
    assert L.license_digest(documents(spark, [])).count() == 0
    long = "word " * 50_000 + "All Rights Reserved " * 3
    row = L.license_digest(documents(spark, [(1, long)])).first()
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (50_009, 3, 50_000, 50_006)


def detections(text):
    """All matches of all rules, without those that one of at least their priority contains."""
    words = re.findall(L.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = set()
    for i, first in enumerate(words):
        for word, pattern, label, priority in L.rules():
            if word == first:
                hit = re.match(f"({pattern})(?: |$)", " ".join(words[i : i + L.WINDOW]))
                if hit:
                    found.add((i, -len(hit[1].split(" ")), -priority, label))
    ordered = sorted(found)
    return [
        (i, -n, label) for at, (i, n, p, label) in enumerate(ordered)
        if not any(p2 <= p and j - m >= i - n for j, m, p2, _ in ordered[:at])
    ]


def test_detections_as_brute_force(spark):
    draw = random.Random(6)
    rules = [re.sub(r"[()\[\]?]", "", pattern) for _, pattern, _, _ in L.rules()]
    bits = ["licensed under the", "MIT License", "apache", "version 2.0", "GNU General Public License", "or", "BSD-3-Clause", "license", "cc by", "nc", "and", "é"]
    rows = [(i, " ".join(draw.choice(rules if draw.random() < 0.4 else bits) for _ in range(draw.randint(1, 8)))) for i in range(60)]
    got = {r.doc_id: [(m.start, m.words, m.label) for m in r.found] for r in L.scan_licenses(documents(spark, rows)).collect()}
    assert got == {i: detections(t) for i, t in rows}
    assert sum(map(len, got.values())) > 60


def test_fifty_thousand_mentions(spark):
    text = "licensed under the MIT License and the GPL. " * 50_000
    started = time.monotonic()
    row = L.license_digest(documents(spark, [(1, text)])).first()
    assert (row.n_words, row.labels, row.score) == (400_000, "gpl,mit", 0.98)
    assert time.monotonic() - started < 90


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(rows, asked, k):
    out = []
    for q, v in rows:
        if q in asked:
            v = np.array(v, np.float32).astype(float)
            scored = sorted((-float(np.array(x, np.float32).astype(float) @ v), i) for i, x in rows if i != q)[:k]
            out += [(q, n + 1, i, round(-s, 9)) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_nearest_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(N, "LIST_ROWS", 100)
    monkeypatch.setattr(N, "BLOCK_VECTORS", 60)
    monkeypatch.setattr(N, "BLOCK_QUERIES", 7)
    draw = np.random.default_rng(3)
    rows = [(i, (draw.normal(size=24) + 2 * draw.normal(size=24) * (i % 5 == 0)).tolist()) for i in range(1200)]
    got = [(q, r, i, round(s, 9)) for q, r, i, s in collected(N.search(vectors(spark, rows), F.col("vec_id") % 20 == 0))]
    expect = brute(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    truth = {(q, i): s for q, _, i, s in expect}
    assert len(got) == len(expect)
    assert sum((q, i) in truth for q, _, i, _ in got) >= 0.9 * len(expect)
    assert all(abs(truth[q, i] - s) < 1e-9 for q, _, i, s in got if (q, i) in truth)
    for q in {g[0] for g in got}:
        mine = sorted(g for g in got if g[0] == q)
        assert [g[1] for g in mine] == list(range(1, 21)) and mine == sorted(mine, key=lambda g: (-g[3], g[2]))


def test_nearest_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []),
        (None, [1.0, 1.0]), (20, [0.5, 0.5]), (2, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (40, None),
    ]
    got = sorted(collected(N.search(vectors(spark, rows).withColumn("list", F.lit("x")).withColumn("score", F.lit(1)), F.col("vec_id") % 20 == 0)))
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 2, 0.5)]
    assert N.search(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_one_vector_in_most_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "LIST_ROWS", 50)
    monkeypatch.setattr(N, "BLOCK_VECTORS", 40)
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=8).round(3).tolist() if i % 3 else [1.0] * 8) for i in range(400)]
    got = [(q, r, i, round(s, 9)) for q, r, i, s in collected(N.search(vectors(spark, rows), F.col("vec_id") % 20 == 0))]
    hot = [g for g in got if g[0] % 3 == 0]
    assert hot == [e for e in hot if e in set(brute(rows, {g[0] for g in hot}, 20))]


@pytest.mark.parametrize("probes", [1, 2])
def test_small_lists_are_widened_to_k_rows(spark, probes):
    """An outlier list of three vectors, an empty one and two full ones."""
    draw = np.random.default_rng(8)
    centres = np.array([[50.0, 0, 0, 0], [40.0, 40, 40, 40], [1.0, 0, 0, 0], [-1.0, 0, 0, 0]])
    rows = [(i, (centres[0] + draw.normal(size=4) / 9).tolist()) for i in range(3)]
    rows += [(i, (centres[2 + i % 2] + draw.normal(size=4) / 9).tolist()) for i in range(3, 83)]
    index = N.Index({4: centres}, {4: N.rotation(4)}, {4: probes})
    got = [(q, r, i, round(s, 9)) for q, r, i, s in collected(N.search(vectors(spark, rows), F.col("vec_id") < 3, index=index))]
    assert sorted(got) == brute(rows, {0, 1, 2}, 20)
    # Fewer candidates than asked for: all of them.
    few = collected(N.search(vectors(spark, rows[:9]), F.col("vec_id") < 3, index=index))
    assert sorted((r[0], r[2]) for r in few) == [(q, i) for q in range(3) for i in range(9) if i != q]


def test_lists_are_taken_in_order_until_they_hold_enough():
    index = N.Index({1: np.array([[4.0], [3.0], [2.0], [1.0]])}, {1: np.eye(1)}, {1: 1})
    held = np.array([3, 0, 18, 500])
    rows, lists = index.searched(np.array([[1.0], [-1.0]]), held, 20)
    assert list(zip(rows.tolist(), lists.tolist(), strict=True)) == [(0, 0), (0, 1), (0, 2), (1, 3)]
