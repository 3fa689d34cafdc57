import pytest
from pyspark.sql import functions as F

from rowloom.operators import expectations, integrity, keys, lint, privacy, profile, rules
from rowloom.operators.expectations import Expectation
from rowloom.plans import joins
from rowloom.plans.catalog import declared_catalog, measured_catalog
from rowloom.plans.spec import BusinessRule, ColumnSpec, DatasetSpec, ForeignKey, TableSpec


@pytest.fixture(scope="module")
def family(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id bigint")
    children = spark.createDataFrame([(10, 1), (11, 2), (12, 99), (13, 99), (14, None)], "id bigint, parent_id bigint")
    return {"parents": parents, "children": children}


FK = ForeignKey("children", ["parent_id"], "parents", ["id"])


def test_ref_integrity(family):
    row = integrity.ref_integrity(family, [FK]).first()
    assert (row.orphan_rows, row.orphan_values, row.sample_value, row.intact) == (2, 1, "99", False)
    assert not integrity.intact(integrity.ref_integrity(family, [FK]))
    good = {**family, "children": family["children"].filter("parent_id < 3")}
    assert integrity.ref_integrity(good, [FK]).first().intact


def test_orphan_rows_hot_and_cold(spark, family, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    child = spark.createDataFrame([(i, 99) for i in range(50)] + [(60, 98), (61, 97), (62, 1), (63, None)], "id int, parent_id bigint")
    found = integrity.orphan_rows(child, ["parent_id"], family["parents"], ["id"])
    assert sorted(r.id for r in found.collect()) == [*range(50), 60, 61]


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("small", [0, 1 << 30])
def test_lookup_with_hot_and_missing_keys(spark, monkeypatch, how, small):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", small)
    left = spark.createDataFrame([(i, k) for i, k in enumerate([1] * 30 + [2] * 3 + [9] * 5 + [3, None, None])], "i int, k int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "k int, v string")
    got = sorted((r.i, r.k, r.v) for r in joins.lookup(left, right, ["k"], how).collect())
    assert got == sorted((r.i, r.k, r.v) for r in left.join(right, "k", how).collect())


def test_composite_reference(spark):
    parent = spark.createDataFrame([(1, "a")], "x int, y string")
    child = spark.createDataFrame([(1, "a"), (1, "b"), (None, "z")], "p int, q string")
    fk = ForeignKey("c", ["p", "q"], "p", ["x", "y"])
    row = integrity.ref_integrity({"c": child, "p": parent}, [fk]).first()
    assert (row.orphan_rows, row.sample_value) == (1, "1|b")


def test_validity_score(spark):
    rows = spark.createDataFrame([(3,)], "total_rows bigint")
    errors = spark.createDataFrame([(1,)], "reference_errors bigint")
    assert profile.validity_score(rows, errors).first().schema_validity_score == pytest.approx(1 - 1 / 3 * 0.1)


def test_profile_and_summary(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    row = profile.table_profile({"t": df}).first()
    assert (row.row_count, row.column_count, row.null_count, row.null_ratio) == (2, 2, 1, 0.25)
    total = profile.dataset_summary(profile.table_profile({"t": df, "u": df.filter("a > 5")})).first()
    assert (total.total_rows, total.total_tables, total.total_nulls, total.overall_null_ratio) == (2, 2, 1, 0.25)


def test_repeated_rows_ignore_null_keys(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (None, 3), (None, 4), (2, 5)], "k int, n int")
    assert sorted(r.n for r in keys.repeated_rows(df, ["k"], "n").collect()) == [1, 2]
    row = keys.duplicate_totals(df, "t", ["k"], ignore_null=True).first()
    assert (row.duplicate_keys, row.duplicate_rows) == (1, 2)
    assert keys.duplicate_totals(df, "t", ["k"]).first().duplicate_keys == 2


def violations(df, **rule):
    return df.filter(rules.violated(BusinessRule("r", table="t", **rule))).count()


def test_row_rules(spark):
    df = spark.createDataFrame([(1, 2), (10, 5), (None, 1), (3, None), (None, None)], "a int, b int")
    assert violations(df, kind="order", expression="a <= b") == 1
    assert violations(df, kind="range", fields=["a", "b"], params={"min": 2, "max": 9}) == 3
    assert violations(df, kind="range", fields=["a"], params={"min": 2}) == 1
    assert violations(df, kind="equality", expression="a == b - 1") == 3
    assert violations(df, kind="custom", expression="a > 5 OR b > 1") == 0
    assert violations(df, kind="custom", params={"callback": lambda: F.col("a") < 5}) == 1
    text = spark.createDataFrame([("ok",), ("no",), (None,)], "s string")
    assert violations(text, kind="enum", fields=["s"], params={"values": ["ok"]}) == 1
    assert violations(text, kind="pattern", fields=["s"], params={"pattern": "^o"}) == 1
    with pytest.raises(ValueError):
        rules.violated(BusinessRule("r", "sum", "t"))


def test_sum_rule(spark):
    parent = spark.createDataFrame([(1, 3.0), (2, 5.0), (3, 0.0), (4, None)], "id int, total double")
    child = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 4.0), (2, None)], "pid int, amount double")
    rule = BusinessRule("s", "sum", "p", params={"total_field": "total", "parent_key": "id", "child_table": "c",
                                                "child_key": "pid", "child_field": "amount"})
    assert [(r.id, r.children_sum) for r in rules.sum_violations(parent, child, rule).collect()] == [(2, 4.0)]
    assert rules.rule_violations({"p": parent, "c": child}, [rule]).first().violations == 1


def test_samples_are_the_first_rows(spark):
    df = spark.range(200).withColumn("v", F.col("id"))
    checks = [BusinessRule(f"r{i}", "custom", "t", expression=f"v < {i}") for i in range(8)]
    got = rules.violation_samples(df, "t", checks, "id").collect()
    assert len(got) == 50
    assert max(r.sample_no for r in got) <= 10
    assert {r.id for r in got if r.rule == "r0"} <= set(range(10))


def test_expectations(spark):
    df = spark.createDataFrame([("1", "a"), ("50", "a"), ("x", None), (None, "b"), ("-", "b")], "n string, s string")
    suite = [
        Expectation(expectations.ROW_COUNT, min_value=6), Expectation(expectations.ROW_COUNT, max_value=5),
        Expectation(expectations.NOT_NULL, "s"), Expectation(expectations.NOT_NULL, "absent"),
        Expectation(expectations.UNIQUE, "s"), Expectation(expectations.IN_SET, "s", value_set=("a",)),
        Expectation(expectations.BETWEEN, "n", min_value=2, max_value=40),
    ]
    got = {r.seq: (r.failing, r.passed) for r in expectations.run_suite(df, "t", suite).collect()}
    assert got == {0: (1, False), 1: (0, True), 2: (1, False), 3: (5, False), 4: (2, False), 5: (2, False), 6: (2, False)}


def test_unique_counts_nulls_as_equal(spark):
    df = spark.createDataFrame([(None,), (None,), (1,)], "k int")
    assert expectations.run_suite(df, "t", [Expectation(expectations.UNIQUE, "k")]).first().failing == 1


def test_suite_puts_references_on_the_child():
    spec = DatasetSpec(
        "d", [TableSpec("parents", [ColumnSpec("id")], ["id"]), TableSpec("children", [ColumnSpec("id"), ColumnSpec("parent_id")], ["id"])],
        [FK],
    )
    child = [(e.kind, e.column) for e in expectations.derive_suite(spec, "children")]
    assert (expectations.NOT_NULL, "parent_id") in child
    assert len(expectations.derive_suite(spec, "parents")) == 3


def test_classification(spark):
    spec = DatasetSpec("d", [
        TableSpec("users", [ColumnSpec("id"), ColumnSpec("email"), ColumnSpec("Mobile-No"), ColumnSpec("dob"), ColumnSpec("x", hint="company")]),
        TableSpec("auth", [ColumnSpec("api_token"), ColumnSpec("password"), ColumnSpec("internal_id"), ColumnSpec("page_id")]),
    ])
    found = privacy.classify(declared_catalog(spark, spec), {("auth", "internal_id"): "government_id"}, hint="hint")
    got = {(r.table_name, r.column_name): (r.category, r.certainty) for r in found.collect()}
    assert got[("users", "id")] == ("unclassified", "unclassified")
    assert got[("users", "email")] == ("email", "detected")
    assert got[("users", "Mobile-No")] == ("phone", "detected")
    assert got[("users", "dob")] == ("date_of_birth", "detected")
    assert got[("users", "x")] == ("name", "detected")
    assert got[("auth", "api_token")] == got[("auth", "password")] == ("credentials", "detected")
    assert got[("auth", "internal_id")] == ("government_id", "detected")
    assert got[("auth", "page_id")] == ("date_of_birth", "suspected")
    warned = {r.warning for r in privacy.warnings(found).collect()}
    assert warned == {
        "Detected credentials field: auth.api_token", "Detected credentials field: auth.password",
        "Detected suspected date_of_birth field: auth.page_id",
    }
    score = privacy.scorecard(privacy.category_summary(found))
    row = score.first()
    assert (row.risk_score, row.risk_level, row.high_risk_categories) == (78, "high", "credentials,government_id")
    blocked = privacy.decide(score, privacy.Policy("enforce", max_risk_score=50))
    assert blocked.first().policy_decision == "block"
    with pytest.raises(privacy.PolicyBlocked):
        privacy.enforce(blocked)
    privacy.enforce(privacy.decide(score, privacy.Policy("advisory", max_risk_score=50)))
    assert privacy.decide(score, privacy.Policy("enforce")).first().policy_decision == "allow"


def test_redaction(spark):
    df = spark.createDataFrame([(1, "secret@test.com"), (2, None)], "id int, email string")
    got = privacy.redact(df, {"email": "email"}).collect()
    assert [(r.id, r.email) for r in got] == [(1, "***@***"), (2, None)]
    assert privacy.redact(df, {"email": "email"}, {"email": "-"}).first().email == "-"


def test_schema_compliance_and_lint(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    got = {(r.finding, r.column_name): r.affected_rows for r in profile.schema_compliance(df, "t", ["a"], ["a", "b", "c"]).collect()}
    assert got == {("unexpected_column", "b"): 1, ("required_null", "b"): 1, ("required_null", "c"): 1}
    catalog = measured_catalog({"t": df})
    none = spark.createDataFrame([], "table_name string, column_name string, parent_table string, parent_column string")
    keyed = spark.createDataFrame([("t", "a"), ("t", "zz")], "table_name string, column_name string")
    found = lint.schema_lint(catalog.unionByName(catalog.filter("column_name = 'a'")), keyed, none).collect()
    assert {(r.finding, r.subject) for r in found} == {("duplicate_column", "a"), ("dangling_key", "zz")}
