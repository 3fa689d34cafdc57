import datetime
import re

from pyspark.sql import functions as F

from rowloom.functions.text import collapse, strip
from rowloom.operators import anomalies, change_tags, drift, layers, messiness


def test_incremental_times(spark):
    df = spark.range(3)
    rows = change_tags.tag_incremental(df, "id", F.col("id") == 2, 42).orderBy("id").collect()
    start = datetime.datetime(2024, 1, 1, 0, 0, 42)
    assert [r.created_at for r in rows] == [start + datetime.timedelta(seconds=17 * i) for i in range(3)]
    assert [(r.updated_at - r.created_at).seconds for r in rows] == [0, 0, 3600]
    assert {r.batch_id for r in rows} == {"batch_42"}


def test_cdc_columns(spark):
    rows = change_tags.tag_cdc(spark.range(2000), "id", F.lit(True), 42, "t").collect()
    shares = {op: sum(r.op_type == op for r in rows) / 2000 for op in change_tags.OPERATIONS}
    assert abs(shares["INSERT"] - 0.7) < 0.05 and abs(shares["UPDATE"] - 0.2) < 0.05 and abs(shares["DELETE"] - 0.1) < 0.05
    assert all((r.deleted_at is not None) == (r.op_type == "DELETE") for r in rows)
    untouched = change_tags.tag_cdc(spark.range(10), "id", F.lit(False), 42, "t")
    assert {r.op_type for r in untouched.collect()} == {"INSERT"}


def test_invalid_operations(spark):
    df = spark.createDataFrame([("INSERT",), (None,), ("MERGE",)], "op_type string")
    row = change_tags.invalid_operations(df).first()
    assert (row.rows_checked, row.invalid_ops, row.cdc_op_type_valid) == (3, 1, False)


def test_messiness_clean_changes_nothing_and_chaotic_something(spark):
    df = spark.createDataFrame([(i, f"Row{i}", str(i * 10)) for i in range(20)], "id bigint, name string, val string")
    assert messiness.apply_messiness(df, "id", "clean", 1, "t") is df
    messy = messiness.apply_messiness(df, "id", "chaotic", 1, "t", F.lit(True), ["val"])
    assert messy.count() == 20
    assert messy.join(df, ["id", "name"], "left_anti").count() > 0


def test_fault_shapes(spark):
    df = spark.createDataFrame([("2024-05-06T01:02:03", "Paid"), ("2024-05-06", "other"), ("x", None)], "d string, s string")
    got = df.select(
        F.expr(messiness.date_format("d", "0L")).alias("slash"), F.expr(messiness.date_format("d", "1L")).alias("dash"),
        F.expr(messiness.enum_spelling("s", "0L")).alias("s"), F.expr(messiness.whitespace("s", "1L")).alias("w"),
    ).collect()
    assert [r.slash for r in got] == ["05/06/2024", "05/06/2024", "x"]
    assert [r.dash for r in got] == ["05-06-2024", "05-06-2024", "x"]
    assert [r.s for r in got] == ["Paid", "other", None]
    assert [r.w for r in got] == ["Paid\t ", "other\t ", None]


def test_raw_text_of_large_numbers(spark):
    df = spark.createDataFrame([(1, 12345678.5), (2, 0.0001), (3, 23.0), (4, None), (5, 1.5e16)], "id int, v double")
    assert [r.v for r in messiness.to_raw(df, ["id"]).orderBy("id").collect()] == [
        "12345678.5", "0.0001", "23.0", None, "1.5E16"]


def test_anomalies_hit_non_null_text(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a", "b", i) for i in range(200)], "id bigint, a string, b string, n int")
    emptied = anomalies.plant(df, "id", F.lit(True), [anomalies.EMPTY_STRING], 1, "t", ["id"]).collect()
    assert all((r.a == "") + (r.b == "") == 1 for r in emptied)
    assert any(r.a == "" for r in emptied)
    broken = anomalies.plant(df, "id", F.lit(True), [anomalies.MALFORMED_STRING], 1, "t", ["id"])
    assert all(anomalies.MALFORMED_VALUE in (r.a, r.b) for r in broken.collect())
    nulled = anomalies.plant(df, "id", F.lit(True), [anomalies.NULL_FIELD], 1, "t", ["id"])
    assert nulled.filter("n IS NULL").count() > 0


def test_anomalies_without_text_columns(spark):
    df = spark.range(10)
    got = anomalies.inject_anomalies(df, "id", 1.0, 1, "t", [anomalies.EMPTY_STRING, anomalies.INVALID_ENUM])
    assert sorted(r.id for r in got.collect()) == list(range(10))


def test_duplicate_rows_and_ratio(spark):
    df = spark.range(1000)
    assert 1000 < anomalies.inject_anomalies(df, "id", 0.5, 1, "t", [anomalies.DUPLICATE_ROW]).count() < 1600
    assert anomalies.effective_ratio(0.5, "clean") == 0.01
    assert anomalies.effective_ratio(0.0, "chaotic") == 0.05
    assert anomalies.effective_ratio(0.3, "realistic") == 0.3


def test_drift_plan_is_stable_and_sized():
    tables = {"a": [("x", "integer"), ("y", "string")], "b": [("z", "string")]}
    assert drift.plan_drift(tables, "none", 1) == []
    for seed in range(20):
        mild, wild = drift.plan_drift(tables, "mild", seed), drift.plan_drift(tables, "aggressive", seed)
        assert len(mild) <= 2 and len(wild) <= 4
        assert wild == drift.plan_drift(tables, "aggressive", seed)


def test_drift_keeps_rows_and_keys(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x")], "id int, v string")
    events = [drift.DriftEvent("t", "rename_column", "id", "id", "id_renamed"),
              drift.DriftEvent("t", "change_type", "v", "string", "integer")]
    got = drift.apply_drift(df, "t", events).orderBy("id_renamed").collect()
    assert [(r.id_renamed, r.v, r.v_unparsed) for r in got] == [(1, 5, None), (2, None, "x")]
    assert drift.renamed_keys(["id"], "t", events) == ["id_renamed"]


def test_silver_strips_and_keeps_first(spark):
    df = spark.createDataFrame(
        [("1", "  foo \x1f", 0), ("1", "late", 1), (None, " ", 2), (None, "b", 3), ("2", "\t", 4)], "k string, v string, n int"
    )
    got = layers.to_layer(df, "silver", "k", "n").orderBy("n").collect()
    assert [(r.k, r.v) for r in got] == [("1", "foo"), (None, None), (None, "b"), ("2", None)]


def test_hot_key_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select(F.expr("id % 3").alias("k"), "id")
    kept = layers.keep_first(df, "k", "id")
    assert sorted(r.id for r in kept.collect()) == [0, 1, 2]
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_gold_collapses_and_is_idempotent(spark):
    df = spark.createDataFrame([(" a  \t b\n\x1cc ",)], "v string")
    gold = layers.gold_normalize(df)
    assert gold.first().v == "a b c"
    assert layers.gold_normalize(gold).first().v == "a b c"


def test_typed_counts_failures(spark):
    df = spark.createDataFrame([("1", "x"), (None, "2.5")], "a string, b string")
    got = layers.typed(df, {"a": "int", "b": "double"}).collect()
    assert [(r.a, r.b, r.cast_failures) for r in got] == [(1, None, 1), (None, 2.5, 0)]


def test_layer_deltas(spark):
    n = {"bronze": 5, "silver": 3, "gold": 1}
    row = layers.layer_deltas({k: {"t": spark.range(v)} for k, v in n.items()}).first()
    assert (row.bronze_to_silver_removed, row.silver_to_gold_removed) == (2, 2)


def test_strip_agrees_with_python(spark):
    cases = ["", " ", "a", " a ", "\x1fa\x85", "\u3000b\u2009", "\u200bz\u200b", "~x~", "\x7fq\x7f", "\u00e9 ", "\n", "x y"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, v string")
    got = [r.s for r in df.select("i", strip(F.col("v")).alias("s")).orderBy("i").collect()]
    assert got == [c.strip() for c in cases]
    one = [r.s for r in df.select("i", collapse(F.col("v")).alias("s")).orderBy("i").collect()]
    assert one == [" ".join(c.split()) for c in cases]


def test_flow_carries_keys_through_drift(spark):
    from rowloom.operators.flow import FlowSettings, run_flow

    rows = spark.range(400).selectExpr("id", "concat('name ', id) AS label", "id * 2 AS amount")
    renamed = 0
    for seed in range(6):
        made = run_flow({"t": rows}, {"t": "id"}, FlowSettings(seed, drift="aggressive", messiness="chaotic", anomalies=0.1), {"t": {"label": "name"}})
        key = made.keys["t"]
        renamed += key != "id"
        counts = {r.stage: r.row_count for r in made.row_counts().collect()}
        assert counts["source"] == counts["silver"] == counts["gold"] == counts["shared"] == 400 and counts["bronze"] >= 400
        assert made.stages["bronze"]["t"].select(key).distinct().count() == 400
    assert renamed
    report = {(r.check, r.subject): r for r in made.report("bronze").collect()}
    assert report[("nulls", key)].failing == 0 and report[("operation", "op_type")].total_rows == counts["bronze"]


def test_flow_rows_show_cells_of_every_stage(spark):
    from rowloom.operators.flow import FlowSettings, run_flow

    rows = spark.range(60).selectExpr("id", "concat('name ', id) AS label", "IF(id % 2 = 0, id * 1.5D, NULL) AS amount")
    settings = FlowSettings(3, drift="none", messiness="clean", changed=0.0, anomalies=0.0)
    made = run_flow({"t": rows}, {"t": "id"}, settings, {"t": {"label": "name"}}).rows({"t": "id"}).collect()
    got = {(r.stage, r.row_key): r.cells for r in made}
    assert len(made) == len(got) == 300 and {r.table_name for r in made} == {"t"}
    assert got["source", 2] == "name 2|3.0" and got["source", 3] == "name 3|-"
    tags = "2024-01-01T00:00:54|batch_3|INSERT|2024-01-01T00:00:54|-"
    assert got["bronze", 3] == got["silver", 3] == got["gold", 3] == f"name 3|-|{tags}"
    assert got["shared", 3].endswith(f"|-|{tags}") and "name 3" not in got["shared", 3]


def test_wide_tables_make_no_huge_methods(spark):
    """The JVM doesn't compile methods of more than 8,000 bytes."""
    # Names as those inside the lambdas must not matter.
    names = ["cell", "at", "flip", *[f"c{i}" for i in range(9)]]
    wide = spark.range(300).select("id", *[F.concat(F.lit(f"Row  {c} 　of "), F.col("id").cast("string")).alias(c) for c in names])
    messy = messiness.apply_messiness(wide, "id", "chaotic", 1, "t")
    gold = layers.gold_normalize(layers.silver_clean(messy, "id"))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", gold._jdf.queryExecution().explainString(mode))]
    assert sizes and max(sizes) < 8000
    rows = gold.collect()
    assert {tuple(r[c].lower() for c in names) for r in rows} == {tuple(f"row {c} of {i}" for c in names) for i in range(300)}
    touched = sum(any(r[c] != f"Row {c} of {r.id}" for c in names) for r in rows)
    assert 0 < touched < 300
    drawn = wide.select("id", *[F.expr(messiness.casing(c, messiness.cell_draw_text("t", c, messiness.row_draw_text(1, "t", "id")))).alias(c) for c in names])
    cased = {r.id: r for r in drawn.collect()}
    for r in rows:
        if any(r[c] != f"Row {c} of {r.id}" for c in names):
            assert [r[c] for c in names] == [" ".join(cased[r.id][c].split()) for c in names]
