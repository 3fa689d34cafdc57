"""Each keyword of JSON Schema, on records one by one."""

import json

import pytest

from rowloom.operators.json_schema import check_schema

TREE = {"$ref": "#/$defs/node", "$defs": {"node": {
    "type": "object", "required": ["v"], "properties": {"v": {"type": "integer"}, "kids": {"type": "array", "items": {"$ref": "#/$defs/node"}}},
}}}
ORDER = {"type": "object", "properties": {"lines": {"type": "array", "items": {
    "type": "object", "required": ["sku"], "additionalProperties": False,
    "properties": {"sku": {"type": "string", "pattern": "^[a-z]"}, "n": {"type": "integer", "minimum": 1}},
}}}}


def deep(n):
    return {"v": 1, "kids": [deep(n - 1)]} if n else {"v": 1}


CASES = [
    # schema, values that hold, values that don't
    ({}, [1, None, {}], []),
    (True, [1], []),
    (False, [], [1, None]),
    ({"type": "integer"}, [1, 2.0, -3], [1.5, "1", None, True]),
    ({"type": "number"}, [1, 1.5, 1e300], ["1", False]),
    ({"type": "string"}, ["", "x"], [1, []]),
    ({"type": "boolean"}, [True], [0, "true"]),
    ({"type": "null"}, [None], [0, ""]),
    ({"type": "array"}, [[], [1, "x"]], [{}]),
    ({"type": "object"}, [{}, {"a": 1}], [[], 1]),
    ({"type": ["string", "null"]}, ["x", None], [1]),
    ({"enum": [1, "a", None, {"b": 1, "a": [2]}]}, [1, "a", None, {"a": [2], "b": 1}], [2, "b", {"a": [2]}]),
    ({"const": {"a": 1}}, [{"a": 1}], [{"a": 2}, 1]),
    ({"minLength": 2, "maxLength": 3}, ["ab", "abc", 5, "é\U0001f600"], ["a", "abcd"]),
    ({"pattern": "^a+$"}, ["aa", 7], ["b", ""]),
    ({"format": "date"}, ["2024-01-05", 3], ["2024-13-01"]),
    ({"format": "nothing known"}, ["x"], []),
    ({"minimum": 2, "maximum": 4}, [2, 4, 3.5, "0"], [1, 4.5]),
    ({"exclusiveMinimum": 2, "exclusiveMaximum": 4}, [3, 2.1], [2, 4]),
    ({"multipleOf": 0.1}, [0.3, 2, "x"], [0.25]),
    ({"multipleOf": 3}, [9, 0, -6], [10]),
    ({"required": ["a", "b"]}, [{"a": None, "b": 1}, 5], [{"a": 1}, {}]),
    ({"properties": {"a": {"type": "integer"}}}, [{"a": 1}, {"b": "x"}, 3], [{"a": "x"}, {"a": None}]),
    ({"properties": {"a.b": {"type": "integer"}, "it's": False}}, [{"a.b": 1, "a": {"b": "x"}}], [{"a.b": "x"}, {"it's": 1}]),
    ({"properties": {"a": {}}, "additionalProperties": False}, [{"a": 1}, {}], [{"a": 1, "b": 2}]),
    ({"additionalProperties": {"type": "integer"}}, [{"x": 1, "y": 2}], [{"x": 1, "y": "z"}]),
    ({"patternProperties": {"^n_": {"type": "integer"}}, "additionalProperties": False}, [{"n_a": 1}], [{"n_a": "x"}, {"m": 1}]),
    ({"propertyNames": {"maxLength": 2}}, [{"ab": 1}, {}], [{"abc": 1}]),
    ({"minProperties": 1, "maxProperties": 2}, [{"a": 1}, 4], [{}, {"a": 1, "b": 2, "c": 3}]),
    ({"dependentRequired": {"a": ["b"]}}, [{"b": 1}, {"a": 1, "b": 1}], [{"a": 1}]),
    ({"items": {"type": "integer"}}, [[], [1, 2], "x"], [[1, "x"], [None]]),
    ({"prefixItems": [{"type": "integer"}], "items": {"type": "string"}}, [[1, "a"], [1], []], [["a"], [1, 2]]),
    ({"minItems": 1, "maxItems": 2}, [[1], [1, 2], "abc"], [[], [1, 2, 3]]),
    ({"uniqueItems": True}, [[1, 2], [{"a": 1}, {"a": 2}], []], [[1, 1], [{"a": 1, "b": 2}, {"b": 2, "a": 1}]]),
    ({"contains": {"type": "integer"}}, [["a", 1], "x"], [["a"], []]),
    ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, [1, 2], [0, 3]),
    ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["x", 6], [4]),
    ({"oneOf": [{"multipleOf": 2}, {"multipleOf": 3}]}, [2, 3], [6, 5]),
    ({"not": {"type": "string"}}, [1], ["x"]),
    ({"if": {"required": ["a"]}, "then": {"required": ["b"]}, "else": {"required": ["c"]}}, [{"a": 1, "b": 1}, {"c": 1}], [{"a": 1}, {}]),
    (TREE, [deep(0), deep(4)], [{}, {"v": 1, "kids": [{"v": "x"}]}, {"v": 1, "kids": [{"v": 1, "kids": [{}]}]}, deep(9)]),
    (ORDER, [{"lines": [{"sku": "a", "n": 1}, {"sku": "b"}]}], [{"lines": [{"sku": "a"}, {"n": 1}]}, {"lines": [{"sku": "A"}]}, {"lines": [{"sku": "a", "m": 1}]}]),
]


def checked(spark, values, schema, **more):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, r string").coalesce(1)
    return {r.i: r for r in check_schema(df, "r", schema, **more).collect()}


@pytest.mark.parametrize("at", range(len(CASES)), ids=[json.dumps(c[0])[:40] for c in CASES])
def test_keyword(spark, at):
    schema, good, bad = CASES[at]
    document = {"$defs": schema["$defs"], "x": schema} if isinstance(schema, dict) and "$defs" in schema else {"x": schema}
    got = checked(spark, [json.dumps(v) for v in [*good, *bad]], document, pointer="#/x")
    assert [got[i].passed for i in range(len(got))] == [True] * len(good) + [False] * len(bad), got
    assert all((r.reason is None) == r.passed and (r.errors == 0) == r.passed for r in got.values())


def test_messages_name_the_place(spark):
    values = ['{"lines":[{"sku":"a"},{"n":0,"z":1}]}', None, "", "{", "1 2", "1,2", '{"lines":[]} x']
    got = checked(spark, values, ORDER)
    assert got[0].reason == "$.lines[1] lacks sku; $.lines[1].n is less than 1; $.lines[1].z is not allowed" and got[0].errors == 3
    assert {got[i].reason for i in range(1, 7)} == {"invalid JSON"}
    assert "nested deeper than 2 references" in checked(spark, [json.dumps(deep(5))], TREE, depth=2)[0].reason


def test_references(spark):
    with pytest.raises(ValueError, match="refers to itself"):
        checked(spark, ["1"], {"$ref": "#/a", "a": {"$ref": "#/b"}, "b": {"$ref": "#/a"}})
    with pytest.raises(ValueError, match="leads nowhere"):
        checked(spark, ["1"], {"$ref": "#/missing"})
    shop = {"components": {"schemas": {"a/b": {"type": "integer"}, "Order": {"properties": {"x": {"$ref": "#/components/schemas/a~1b"}}}}}}
    got = checked(spark, ['{"x":1}', '{"x":"y"}'], shop, pointer="#/components/schemas/Order")
    assert got[0].passed and got[1].reason == "$.x is not integer"
