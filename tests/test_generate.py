import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from rowloom.functions import providers, rng
from rowloom.functions.shapes import apply_shape
from rowloom.operators import foreign_keys, generate, indexing, selection
from rowloom.plans.spec import (
    ColumnSpec, DatasetSpec, ForeignKey, Shape, TableSpec, ValueRule, plan_row_counts, rule_problems,
)


def values(spark, rule, rows, seed=1):
    df = generate.row_index(spark, rows).select("row_idx", generate.rule_value(rule, seed, "t.c", "row_idx").alias("v"))
    return [r.v for r in df.orderBy("row_idx").collect()]


def python_draw(seed, tag, key):
    """The draw in plain integers."""
    shift, flip = rng.salts(seed, tag)
    start = (key + shift) & rng.LOW32
    first = ((start ^ (start >> 16)) * rng.MIX) & rng.LOW32
    upper = ((key >> 32) * rng.HIGH_MIX) & rng.LOW32
    second = ((first ^ (first >> 16) ^ upper ^ flip) * rng.MIX) & rng.LOW32
    return second ^ (second >> 16)


def test_draw_matches_integer_arithmetic(spark):
    keys = [0, 1, 2, 4294967295, 4294967296, 4294967297, 10**13, 2**40 + 5]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", rng.draw(7, "x", "k").alias("d"))
    assert {r.k: r.d for r in df.collect()} == {k: python_draw(7, "x", k) for k in keys}


def test_draw_is_uniform_and_tags_differ(spark):
    df = spark.range(200_000).select(rng.uniform(3, "a", "id").alias("a"), rng.uniform(3, "b", "id").alias("b"))
    mean, spread, together = df.agg(F.avg("a"), F.stddev("a"), F.corr("a", "b")).first()
    assert abs(mean - 0.5) < 0.005 and abs(spread - 12**-0.5) < 0.005 and abs(together) < 0.01


def test_sequence_and_static(spark):
    assert values(spark, ValueRule("sequence", {"start": 10, "step": 2}), 3) == [10, 12, 14]
    assert values(spark, ValueRule("static", {"value": "x"}), 2) == ["x", "x"]


def test_range_bounds(spark):
    whole = values(spark, ValueRule("range", {"min": 5, "max": 10}), 300)
    assert set(whole) == set(range(5, 11))
    real = values(spark, ValueRule("range", {"min": 0.0, "max": 0.5}), 300)
    assert all(0 <= v < 0.5 and round(v, 4) == v for v in real)
    assert values(spark, ValueRule("range", {"min": 3, "max": 3}), 1) == [3.0]


def test_weighted_choice_and_nulls(spark):
    picked = values(spark, ValueRule("weighted_choice", {"choices": ["a", "b"], "weights": [9, 1]}), 4000)
    assert 0.87 < picked.count("a") / 4000 < 0.93
    assert set(values(spark, ValueRule("weighted_choice", {"choices": ["a", "b"], "weights": [0, 1]}), 50)) == {"b"}
    sparse = values(spark, ValueRule("static", {"value": 1, "null_probability": 0.25}), 4000)
    assert 0.22 < sparse.count(None) / 4000 < 0.28


def test_uuids_are_unique_and_well_formed(spark):
    made = values(spark, ValueRule("uuid"), 2000)
    assert len(set(made)) == 2000 and all(str(uuid.UUID(v)) == v for v in made)


def test_providers_and_locales(spark):
    emails = values(spark, ValueRule("faker", {"provider": "email"}), 50)
    assert all("@" in e for e in emails)
    german = generate.row_index(spark, 20).select(
        generate.rule_value(ValueRule("faker", {"provider": "person"}), 1, "t", "row_idx", "de_DE").alias("v")
    )
    assert all(r.v.split()[0] in providers.FIRST_NAMES["de"] for r in german.collect())
    assert all(" " in v for v in values(spark, ValueRule("faker", {"provider": "no such provider"}), 5))


def test_rule_problems():
    assert rule_problems(ValueRule("nonsense"))
    assert rule_problems(ValueRule("faker", {}))
    assert rule_problems(ValueRule("range", {"min": 3, "max": 1}))
    assert rule_problems(ValueRule("weighted_choice", {"choices": ["a"], "weights": [1, 2]}))
    assert rule_problems(ValueRule("static", {"value": 1, "null_probability": 1.0}))
    assert not rule_problems(ValueRule("sequence"))
    with pytest.raises(ValueError):
        generate.rule_value(ValueRule("static"), 1, "t.c", "row_idx")


TABLE = TableSpec(
    "test",
    [ColumnSpec("id", "integer", rule=ValueRule("sequence", {"start": 1})), ColumnSpec("email", "email"),
     ColumnSpec("day", "date"), ColumnSpec("price", "currency", max_value=10)],
    ["id"],
)


def test_key_rule_wins_over_surrogate(spark):
    rows = generate.generate_table(spark, TABLE, 5, 42).orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2, 3, 4, 5]
    assert all("@" in r.email and isinstance(r.day, datetime.date) and 0 <= r.price < 10 for r in rows)


def test_slices_and_partitions_do_not_change_values(spark):
    whole = generate.generate_table(spark, TABLE, 100, 9)
    parts = generate.generate_table(spark, TABLE, 100, 9, 0, 37).union(generate.generate_table(spark, TABLE, 100, 9, 37, 63))
    again = generate.generate_rows(generate.row_index(spark, 100, partitions=7), TABLE, 9, keep_index=False)
    assert sorted(whole.collect()) == sorted(parts.collect()) == sorted(again.collect())
    assert generate.generate_table(spark, TABLE, 100, 9, 100, 5).count() == 0


def test_row_plan():
    spec = DatasetSpec("d", [TableSpec(n, [ColumnSpec("id", "bigint")]) for n in ("users", "orders", "order_items", "misc")])
    assert plan_row_counts(spec, 10) == {"users": 10, "orders": 20, "order_items": 30, "misc": 10}
    assert plan_row_counts(spec, 10, ["misc"]) == {"misc": 10}


def test_load_order_breaks_cycles():
    tables = [TableSpec(n, [ColumnSpec("id")]) for n in ("c", "b", "a")]
    links = [ForeignKey("c", ["x"], "b", ["id"]), ForeignKey("b", ["x"], "c", ["id"]), ForeignKey("a", ["x"], "a", ["id"])]
    assert DatasetSpec("d", tables, links).load_order() == ["a", "b", "c"]


def test_generated_keys_close(spark):
    spec = DatasetSpec(
        "d",
        [TableSpec("users", [ColumnSpec("id", "bigint")], ["id"]),
         TableSpec("orders", [ColumnSpec("id", "bigint"), ColumnSpec("user_id", "bigint"), ColumnSpec("ref", "uuid")], ["id"]),
         TableSpec("order_items", [ColumnSpec("id", "bigint"), ColumnSpec("ref", "uuid")], ["id"])],
        [ForeignKey("orders", ["user_id"], "users", ["id"]), ForeignKey("order_items", ["ref"], "orders", ["ref"])],
    )
    made = generate.generate_dataset(spark, spec, 50, 3)
    assert made["orders"].join(made["users"], made["orders"].user_id == made["users"].id, "left_anti").count() == 0
    assert made["order_items"].join(made["orders"], "ref", "left_anti").count() == 0
    assert made["order_items"].count() == 150


@pytest.mark.parametrize("limit", [1, 1_000])
def test_assign_foreign_key_onto_existing_parents(spark, limit):
    parents = spark.createDataFrame([(7,), (3,), (None,), (11,)], "k bigint")
    child = spark.range(8).withColumnRenamed("id", "i").withColumn("fk", F.lit(None).cast("bigint"))
    got = foreign_keys.assign_foreign_key(child, "i", "fk", parents, "k", limit).orderBy("i").collect()
    assert [r.fk for r in got] == [3, 7, 11, 3, 7, 11, 3, 7]


def test_dense_index_is_dense_and_ordered(spark):
    df = spark.range(0, 5000, 1, 9).select(rng.draw(1, "o", "id").alias("h"), "id")
    got = indexing.dense_index(df, ["h", "id"]).orderBy("row_idx").collect()
    assert [r.row_idx for r in got] == list(range(5000))
    assert [(r.h, r.id) for r in got] == sorted((r.h, r.id) for r in got)


@pytest.mark.parametrize("ratio,at_least,expected", [(0.137, 1, 137), (0.0001, 1, 1), (0.0001, 0, 0), (1.0, 1, 1000), (0.5, 1, 500)])
def test_exact_share(spark, ratio, at_least, expected):
    df = spark.range(1000)
    assert df.filter(selection.exact_share(df, ratio, 5, "p", "id", at_least)).count() == expected


def test_exact_share_cap_and_empty(spark):
    df = spark.range(1000)
    assert df.filter(selection.exact_share(df, 0.5, 5, "p", "id", at_most=12)).count() == 12
    assert df.filter(selection.exact_share(df.filter("id < 0"), 0.5, 5, "p", "id")).count() == 0


def test_exact_share_ties(spark):
    # Keys 2**32 apart may share a draw only by chance, so equal draws are forced through equal low halves.
    keys = spark.range(64).select((F.col("id") * 2**32).alias("id"))
    assert keys.filter(selection.exact_share(keys, 0.25, 5, "p", "id")).count() == 16


def test_shapes(spark):
    base = spark.range(20_000).withColumn("one", F.lit(1.0))

    def shaped(kind, shape):
        return base.select(apply_shape(F.col("one"), kind, shape, 4, "s", "id").alias("v"))

    mean, spread = shaped("float", Shape("normal", {"mu": 10, "sigma": 2})).agg(F.avg("v"), F.stddev("v")).first()
    assert abs(mean - 10) < 0.1 and abs(spread - 2) < 0.1
    assert shaped("integer", Shape("lognormal", {"mu": 0, "sigma": 1})).agg(F.min("v")).first()[0] >= 0
    low, high = shaped("float", Shape("seasonal", {"amplitude": 3.0})).agg(F.min("v"), F.max("v")).first()
    assert 1.0 <= low and high <= 3.0
    assert shaped("float", Shape("long_tail", {})).filter("v >= 10").count() / 20_000 == pytest.approx(0.1, abs=0.01)
    assert shaped("string", Shape("categorical", {"categories": []})).filter("v != 1.0").count() == 0
    assert shaped("float", Shape("uniform", {})).filter("v != 1.0").count() == 0
