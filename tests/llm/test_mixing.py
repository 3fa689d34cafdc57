import hashlib
import math
from collections import Counter

import pytest
from helpers import collected, documents, duck

from rowloom.llm import mixing as M


def inverted(rate, u):
    k, p, total = 0, math.exp(-rate), math.exp(-rate)
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def uniform(doc_id):
    return int(hashlib.md5(f"{M.SEED}|count|{doc_id}".encode()).hexdigest()[:13], 16) / 2**52


def test_counts_by_inversion_and_sql_twin(spark):
    rows = [(i, f"text {i}", "en", "a" if i % 3 else "b") for i in range(300)]
    got = Counter(r.doc_id for r in M.mix_sources(documents(spark, rows)).collect())
    rate = {"a": 150 / 200, "b": 150 / 100}
    assert all(got.get(i, 0) == inverted(rate[s], uniform(i)) for i, _, _, s in rows)
    assert sorted(collected(M.mix_sources(documents(spark, rows)))) == sorted(duck(rows, M.ORACLE))


def test_weights_rows_and_partitions(spark):
    rows = [(i, "t", "en", "a" if i < 2000 else "b" if i < 2500 else "c") for i in range(3000)]
    df = documents(spark, rows)
    made = M.mix_sources(df, {"a": 1, "b": 3}, rows=6000)
    n = Counter(r.source for r in made.collect())
    assert set(n) == {"a", "b"} and abs(n["a"] - 1500) < 200 and abs(n["b"] - 4500) < 300
    again = M.mix_sources(df.repartition(7), {"a": 1, "b": 3}, rows=6000)
    assert sorted(collected(made)) == sorted(collected(again))


def test_salted_join_gives_the_same(spark, monkeypatch):
    df = documents(spark, [(i, "t", "en", None if i % 2 else "s") for i in range(200)])
    broadcast = sorted(collected(M.mix_sources(df)), key=str)
    monkeypatch.setattr(M, "BROADCAST_STEPS", 0)
    assert sorted(collected(M.mix_sources(df)), key=str) == broadcast


@pytest.mark.parametrize("rate", [0.3, 150.0, 250.0, 5000.0])
def test_high_rates_have_their_distribution(spark, rate):
    df = documents(spark, [(i, "t", "en", "s") for i in range(400)])
    n = [r.n for r in M.mix_sources(df, rows=400 * rate).groupBy("doc_id").count().selectExpr("count AS n").collect()]
    mean = sum(n) / 400
    assert abs(mean - rate) < 5 * math.sqrt(rate / 400)


def test_defined_cases(spark):
    rows = [(1, None, "en", None), (1, None, "en", None), (None, "x", "en", "s"), (None, "x", "en", "s"), (2, "", None, "s")]
    df = documents(spark, rows, clashing=True)
    made = M.mix_sources(df, rows=50)
    assert made.columns == [*df.columns, "_copy", "_mix_order"]
    n = Counter((r.doc_id, r.text) for r in made.collect())
    assert n[(1, None)] % 2 == 0 and n[(None, "x")] % 2 == 0 and all(n[k] for k in n)
    assert M.mix_sources(documents(spark, [])).count() == 0
    assert M.mix_sources(df, {"unknown": 1.0}).count() == 0
    with pytest.raises(ValueError):
        M.mix_sources(df, {"s": -1.0})
