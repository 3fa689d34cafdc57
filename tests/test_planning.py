"""Row planners, composite foreign keys, references in sample records, orphan samples."""

import json

import pytest
from pyspark.sql import functions as F

from rowloom.operators.foreign_keys import assign_foreign_key
from rowloom.operators.generate import generate_dataset, json_records
from rowloom.operators.integrity import orphan_samples
from rowloom.plans import joins
from rowloom.plans.planning import ByName, PerParent, planned_rows, register_row_planner, row_planner
from rowloom.plans.spec import ColumnSpec, DatasetSpec, ForeignKey, TableSpec

SPEC = DatasetSpec(
    "shop",
    [TableSpec(t, [ColumnSpec("id", "bigint"), ColumnSpec("up", "bigint")], ["id"]) for t in ("a", "b", "c")],
    [ForeignKey("b", ["up"], "a", ["id"]), ForeignKey("c", ["up"], "b", ["id"])],
)


class Fixed:
    def __init__(self, **counts):
        self.counts = counts

    def plan_row_counts(self, spec, scale, only=None):
        return self.counts


def test_a_planner_changes_the_counts(spark):
    register_row_planner("mine", Fixed(a=3, b=7, c=0))
    made = generate_dataset(spark, SPEC, 100, 1, planner="mine")
    assert {t: df.count() for t, df in made.items()} == {"a": 3, "b": 7, "c": 0}
    keys = {r.id for r in made["a"].collect()}
    assert {r.up for r in made["b"].collect()} == keys
    assert row_planner("by_name").plan_row_counts(SPEC, 5) == ByName().plan_row_counts(SPEC, 5) == {"a": 5, "b": 5, "c": 5}


def test_rows_per_parent():
    planner = PerParent({"b": 2.5, ("c", "b"): 3}, roots={"a": 4})
    assert planner.plan_row_counts(SPEC, 99) == {"a": 4, "b": 10, "c": 30}
    assert planner.plan_row_counts(SPEC, 99, ["c"]) == {"c": 30}
    assert PerParent().plan_row_counts(SPEC, 6) == {"a": 6, "b": 6, "c": 6}


def test_wrong_planners():
    for counts, message in (({"zz": 1}, "lacks"), ({"a": -1}, "rows"), ({"a": 1.5}, "rows"), ({"a": True}, "rows")):
        with pytest.raises(ValueError, match=message):
            planned_rows(Fixed(**counts), SPEC, 1)
    with pytest.raises(ValueError, match="unknown row planner"):
        row_planner("nobody")
    with pytest.raises(TypeError):
        register_row_planner("no", object())


@pytest.mark.parametrize("bound", [0, 1000])
def test_composite_key(spark, bound):
    parents = spark.createDataFrame([(2, "b"), (1, "z"), (None, "x"), (1, None), (1, "a"), (2, "b")], "k int, l string")
    child = spark.range(9).select(F.col("id"), F.lit("old").alias("pl"))
    made = assign_foreign_key(child, "id", ["pk", "pl"], parents, ["k", "l"], bound)
    order = [(1, "a"), (1, "z"), (2, "b"), (2, "b")]
    assert sorted(map(tuple, made.select("id", "pk", "pl").collect())) == [(i, *order[i % 4]) for i in range(9)]
    assert assign_foreign_key(child, "id", ["pk", "pl"], parents.filter("k > 9"), ["k", "l"], bound).columns == child.columns
    with pytest.raises(ValueError, match="as many columns"):
        assign_foreign_key(child, "id", ["pk"], parents, ["k", "l"])


def sample(schema, seed, root, depth):
    """The same by plain recursion."""
    while "$ref" in schema:
        if depth <= 0:
            return None
        name = schema["$ref"].split("/")[-1]
        schema, depth = root["components"]["schemas"][name], depth - 1
    if schema["type"] == "integer":
        return seed
    if schema["type"] == "array":
        if "$ref" in schema["items"] and depth <= 0:
            return []
        return [sample(schema["items"], seed + i, root, depth) for i in range(min(2, seed % 3 + 1))]
    return {k: sample(v, seed + 7 * i, root, depth) for i, (k, v) in enumerate(schema["properties"].items())}


@pytest.mark.parametrize("depth", range(4))
def test_references_in_samples(spark, depth):
    root = {"components": {"schemas": {
        "Tree": {"type": "object", "properties": {"id": {"$ref": "#/components/schemas/Id"}, "left": {"$ref": "#/components/schemas/Tree"}, "kids": {"type": "array", "items": {"$ref": "#/components/schemas/Tree"}}}},
        "Id": {"type": "integer"},
    }}}
    schema = {"type": "object", "properties": {"n": {"type": "integer"}, "top": {"$ref": "#/components/schemas/Tree"}}}
    got = spark.range(5).select("id", json_records(F.col("id"), schema, root, depth).alias("j")).collect()
    assert all(str(json.loads(r.j)) .replace("'", "") == str(sample(schema, r.id, root, depth)).replace("'", "") for r in got)
    with pytest.raises(ValueError, match="leads nowhere"):
        json_records(F.lit(1), {"$ref": "#/components/schemas/None"}, root)


def test_first_orphans(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    child = spark.createDataFrame([(i, i % 4, None if i == 3 else "x") for i in range(40)] + [(7, 9, "x"), (None, 8, "x")], "id int, fk int, fl string")
    parent = spark.createDataFrame([(0, "x"), (2, "x"), (None, "x")], "pk int, pl string")
    fk = ForeignKey("child", ["fk", "fl"], "parent", ["pk", "pl"])
    got = orphan_samples({"child": child, "parent": parent}, [fk], {"child": ["id"]}, 4).collect()
    assert sorted((r.sample_no, r.row_key, r.value) for r in got) == [(1, "", "8|x"), (2, "1", "1|x"), (3, "5", "1|x"), (4, "7", "3|x")]
    assert got[1].foreign_key == fk.name and "child.fk,fl of row 1 is 1|x, which parent lacks" in {r.message for r in got}
    whole = orphan_samples({"child": child.filter("fk = 0"), "parent": parent}, [fk], {"child": ["id"]})
    assert whole.count() == 0
