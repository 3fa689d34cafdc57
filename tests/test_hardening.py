"""Limits, odd cells and plan shapes that the given tables don't show."""

import json
import os
import pathlib
import subprocess
import sys
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from rowloom.operators import contracts, diff, events, expectations, reconcile, rules, runlog, selection
from rowloom.operators.generate import generate_rows
from rowloom.plans import scratch
from rowloom.plans.catalog import counted_catalog, schema_catalog
from rowloom.plans.spec import BusinessRule, ColumnSpec, TableSpec
from rowloom.sources import readers, writers


def test_all_orphan_links_are_listed(spark):
    notes = spark.range(250).select(F.concat(F.lit("gone_"), "id").alias("linked_event_id"))
    made = spark.createDataFrame([("evt_1",)], "event_id string")
    assert events.orphan_links(made, notes).count() == 250
    assert events.orphan_links(made, notes, 7).count() == 7
    row = events.link_totals(made, notes.union(spark.createDataFrame([("evt_1",), ("evt_1",), ("",), (None,)], "x string"))).first()
    assert (row.linked_notes, row.linked_event_count, row.orphan_link_count, row.total_events) == (253, 1, 250, 1)


def test_text_of_any_declared_length(spark):
    spec = TableSpec("t", [ColumnSpec("body", "text", min_length=3_000, max_length=4_000, nullable=False)])
    rows = generate_rows(spark.range(50).withColumnRenamed("id", "row_idx"), spec, 1, keep_index=False).collect()
    assert all(3_000 <= len(r.body) <= 4_000 for r in rows) and max(len(r.body) for r in rows) > 3_500


def test_at_most_holds_at_full_ratio(spark):
    df = spark.range(40)
    chosen = selection.exact_share(df, 1.0, 1, "x", "id", at_most=9)
    assert df.filter(chosen).count() == 9


CELLS = ["  lead", "trail\t ", "a\nb", "a\r\nb", 'say "hi"', "back\\slash", "comma, here", "", "plain", "#x", "'", "\\\"", " "]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CELLS)], "id int, v string")
    path = writers.write_csv(df, str(tmp_path / "cells.csv"))
    back = {int(r.id): r.v for r in readers.scan_csv(spark, path).collect()}
    assert back == dict(enumerate(CELLS))


def test_layers_as_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "  a\nb "), (1, 1, "later"), (2, 2, "c  d")], "k int, n int, v string")
    paths = writers.write_layers(df, str(tmp_path), "t", "k", "n", kind="csv")
    assert sorted((r.k, r.v) for r in readers.scan_csv(spark, paths["bronze"]).collect()) == [("1", "  a\nb "), ("1", "later"), ("2", "c  d")]
    assert sorted((r.k, r.v) for r in readers.scan_csv(spark, paths["gold"]).collect()) == [("1", "a b"), ("2", "c d")]


def test_tables_of_a_folder_named_like_one_above(spark, tmp_path):
    folder = tmp_path / "data" / "x" / "data"
    folder.mkdir(parents=True)
    spark.range(3).write.parquet(str(folder / "t.parquet"))
    (folder / "u.csv").write_text("a\n1\n")
    (folder / "empty.csv").write_text("")
    assert {n: k for n, (_, k) in readers.list_tables(spark, str(folder)).items()} == {"t": "parquet", "u": "csv"}


def test_fingerprints_tell_moved_text_apart(spark):
    def of(*row):
        return reconcile.table_fingerprint(spark.createDataFrame([row], "a string, b string"), "t").first()

    prints = {tuple(of(*r)) for r in [("x|y", "z"), ("x", "y|z"), (None, "~"), ("~", None), ("-", None), ("", "x"), ("1:x", "y"), ("x", "1:y")]}
    assert len(prints) == 8


def test_contract_names_with_dots_and_quotes(spark):
    df = spark.createDataFrame([('{"a.b": "x"}',), ('{"a.b": 1}',), ('{"a": {"b": "x"}, "a.b": 2}',), ('{"it\'s": 1}',)], "r string")
    checked = contracts.check_records(df, "r", contracts.Contract("c", types={"a.b": "integer"})).collect()
    assert [r.passed for r in checked] == [False, True, True, True]
    odd = contracts.check_records(df, "r", contracts.Contract("c", types={"it's": "string"})).collect()
    assert [r.passed for r in odd] == [True, True, True, False]


def test_long_and_escaped_secrets(spark):
    long = '\\"' * 500_000
    raw = [
        f'{{"password": "{long}", "n": 1}}', '{"a": "x\\\\", "token": "s\\\\\\"t", "b": "\\\\"}', '{"user": "password", "x": "y"}',
        '{"api_key": "", "q": "\\"password\\": \\"x\\""}',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, c string")
    got = [r.c for r in df.select("i", runlog.mask_secrets("c").alias("c")).orderBy("i").collect()]
    assert got == ['{"password": "***", "n": 1}', '{"a": "x\\\\", "token": "***", "b": "\\\\"}', raw[2], raw[3]]
    assert all(json.loads(t) for t in got)


def dirty(spark):
    return spark.createDataFrame(
        [("1", "2", 5.0), ("x", "2", 5.0), ("9", "2", 5.0), (None, "2", 5.0), ("10", "9", 5.0), ("__INVALID__", "__INVALID__", 1.0)],
        "a string, b string, n double",
    )


@pytest.mark.parametrize(("expression", "broken"), [("a <= n", 2), ("n >= a", 2), ("a <= b", 3), ("a < 10", 1), ("b > n", 4)])
def test_order_rules_on_text(spark, expression, broken):
    df = dirty(spark)
    rule = BusinessRule("r", "order", "t", expression=expression)
    assert rules.row_violations(df, "t", [rule]).first().violations == broken


def test_range_rules_on_text(spark):
    rule = BusinessRule("r", "range", "t", fields=["a", "n"], params={"min": 2, "max": 9})
    df = dirty(spark)
    assert rules.row_violations(df, "t", [rule]).first().violations == 3
    assert rules.violation_samples(df.withColumn("k", F.monotonically_increasing_id()), "t", [rule], "k").count() == 3


def test_sums_with_odd_numbers(spark):
    parent = spark.createDataFrame([(1, 3.0), (2, 3.0), (3, 3.0), (4, float("nan"))], "id int, total double")
    child = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, float("nan")), (2, 3.0), (3, float("inf")), (4, 1.0)], "p int, x double")
    rule = BusinessRule("s", "sum", "t", params={"child_table": "c", "parent_key": "id", "child_key": "p", "total_field": "total", "child_field": "x"})
    assert [r.id for r in rules.sum_violations(parent, child, rule).collect()] == [3]


def test_uniqueness_of_a_missing_column(spark):
    suite = [expectations.Expectation(expectations.UNIQUE, "gone")]
    two, one = spark.range(2), spark.range(1)
    assert [expectations.run_suite(df, "t", suite).first().passed for df in (two, one)] == [False, True]


def test_catalogs_read_no_column(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "a int, b string").write.parquet(str(tmp_path / "t"))
    tables = {"t": spark.read.parquet(str(tmp_path / "t"))}
    assert "FileScan" not in schema_catalog(tables)._jdf.queryExecution().toString()
    counted = counted_catalog(tables)
    assert "ReadSchema: struct<>" in counted._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.column_name, r.data_type, r.row_count) for r in counted.collect()) == [("a", "int", 1), ("b", "string", 1)]


def test_config_versions_meet_by_key(spark):
    left = spark.createDataFrame([(1, '{"a": 1, "s": {"x": 1, "y": 2}}'), (2, '{"a": 1}'), (3, '{"z": 0}')], "k int, c string")
    right = spark.createDataFrame([(1, '{"a": 1, "s": {"x": 1, "y": 3}}'), (2, '{"a": 1}'), (4, '{"w": [1]}')], "k int, c string")
    got = sorted(tuple(r) for r in diff.config_diff(left, right, "k", "c").collect())
    assert got == [(1, "s.y", "2", "3"), (3, "z", "0", None), (4, "w", None, "[1]")]


def test_run_metrics_in_one_pass(spark):
    schema = "run_type string, status string, error_message string, duration_seconds double, summary struct<total_rows: bigint, total_rows_generated: bigint, rows_generated: bigint>"
    long = "e" * 200
    log = spark.createDataFrame([("generate", "failed", long + "1", 1.0, (1, None, None)), ("x", "failed", long + "2", None, None), (None, None, None, 2.0, (None, 5, None))], schema)
    got = {(r.metric, r.label): r.value for r in runlog.run_metrics(log).collect()}
    assert got[("failures", long + "1")] == got[("failures", long + "2")] == 1
    assert (got[("total_runs", "all")], got[("total_rows", "all")], got[("average_duration_seconds", "all")]) == (3, 6, 1.5)
    assert {(r.metric, r.label): r.value for r in runlog.run_metrics(log, 10).collect()}[("failures", "e" * 10)] == 2
    empty = {r.metric: r.value for r in runlog.run_metrics(log.limit(0)).collect()}
    assert empty == {"total_runs": 0, "total_rows": 0, "average_duration_seconds": None}


def test_no_machine_local_scratch_on_a_cluster():
    class Conf:
        def get(self, name, default):
            return default

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError):
        scratch.scratch_root(SimpleNamespace(sparkContext=context, conf=Conf()))


def test_contracts_in_depth(spark):
    inner = contracts.Contract("p", required=["id"], types={"id": "integer"}, enums={"kind": ["a", 1, None]})
    whole = contracts.Contract(
        "c", required=["at", "who"], types={"at": "string"}, formats={"at": "date", "mail": "email"}, items={"tags": "string", "n": "number"}, nested={"who": inner}
    )
    rows = [
        ('{"at": "2024-02-03", "who": {"id": 1, "kind": "a"}, "tags": ["x"], "n": [1, 2.5]}', None),
        ('{"at": "2024-02-03", "who": {"id": 1, "kind": null}, "tags": []}', None),
        ('{"at": "2024-13-03", "who": {"id": "1"}}', "property at is no date; property who.id is not integer"),
        ('{"at": 5, "who": {}}', "property at is not string; missing required property: who.id"),
        ('{"at": "2024-02-03", "who": {"id": 1, "kind": "b"}, "tags": [1], "mail": "x"}',
         "property mail is no email; items of tags are not all string; property who.kind is none of the allowed values"),
        ('{"who": null}', "missing required property: at"),
        ("[1]", "Expected object"), ("{", "Invalid JSON"), (None, "Invalid JSON"),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], "i int, r string")
    got = [r.reason for r in contracts.check_records(df, "r", whole).orderBy("i").collect()]
    assert got == [reason for _, reason in rows]


def test_entry_without_a_package_of_the_optional_part(tmp_path):
    """A machine without one third-party package keeps all queries that don't need it."""
    root = pathlib.Path(__file__).parent.parent
    (tmp_path / "ahocorasick.py").write_text("raise ImportError('not here', name='ahocorasick')")
    code = "import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; q = e.queries(); print(len(q) > 150, 'pipeline' in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env={**os.environ, "PYTHONPATH": f"{tmp_path}:{root}"}, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() in (["True", "False"], ["True", "True"]) and not done.returncode, done.stderr
    if (root / "rowloom" / "llm").is_dir():
        assert done.stdout.split() == ["True", "False"]


def test_retention_of_more_runs_than_are_broadcast(spark, monkeypatch):
    rows = [(f"r{i:03}", "generate", "succeeded", f"2024-01-{1 + i % 28:02} 00:00:00", False, False) for i in range(60)]
    runs = spark.createDataFrame(rows, "run_id string, run_type string, status string, created_at string, pinned boolean, archived boolean")
    runs = runs.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")

    def left():
        return sorted(r.run_id for r in runlog.retention_candidates(runs, runlog.RetentionPolicy(25), now).collect())

    few = left()
    monkeypatch.setattr(runlog, "BROADCAST_RUNS", 10)
    newest = {r[0] for r in sorted(sorted(rows), key=lambda r: r[3], reverse=True)[:25]}
    assert left() == few == sorted({r[0] for r in rows} - newest)
