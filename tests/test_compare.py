import datetime

from pyspark.sql import functions as F

from rowloom.operators import diff, reconcile, runlog
from rowloom.plans.catalog import measured_catalog


def counts(spark, pairs):
    return spark.createDataFrame(pairs, "table_name string, row_count bigint")


def test_reconcile_counts(spark):
    got = reconcile.reconcile_counts(
        counts(spark, [("orders", 100), ("products", 10), ("same", 1)]), counts(spark, [("orders", 2), ("same", 1)])
    ).collect()
    assert {(r.table_name, r.expected_rows, r.actual_rows, r.missing) for r in got} == {
        ("orders", 100, 2, False), ("products", 10, 0, True)}


def test_load_check(spark):
    got = reconcile.load_check(
        {"t1": spark.range(10), "t2": spark.range(5)}, {"t1": spark.range(10)}
    ).orderBy("table_name").collect()
    assert [(r.table_name, r.loaded_rows, r.missing, r.matches) for r in got] == [("t1", 10, False, True), ("t2", 0, True, False)]


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    one = reconcile.table_fingerprint(df, "t").first()
    assert one == reconcile.table_fingerprint(df.repartition(5).orderBy(F.desc("id")), "t").first()
    assert one != reconcile.table_fingerprint(df.withColumn("v", F.col("v") + 1), "t").first()
    assert one != reconcile.table_fingerprint(df.unionByName(df.limit(2)), "t").first()


def test_schema_versions(spark):
    left = measured_catalog({"orders": spark.createDataFrame([(1, "x")], "id int, status string")})
    right = measured_catalog({"orders": spark.createDataFrame([(1,)], "id int")})
    changes = diff.schema_diff(left, right)
    assert [(r.change, r.column_name) for r in changes.collect()] == [("column_removed", "status")]
    row = diff.compatibility(changes).first()
    assert (row.status, row.breaking_count) == ("breaking", 1)
    assert diff.compatibility(diff.schema_diff(left, left)).first().status == "compatible"


def test_flatten_opens_plain_objects_only(spark):
    df = spark.createDataFrame([(1, '{"a":1,"b":{"c":"x","d":null},"e":{"f":{"g":1}},"h":[1],"i":{"j":[2]},"z":{}}')], "k int, config string")
    got = {r.path: r.value for r in diff.flatten_config(df, "k", "config").collect()}
    assert got == {"a": "1", "b.c": '"x"', "b.d": "null", "e": '{"f":{"g":1}}', "h": "[1]", "i": '{"j":[2]}'}


def test_config_diff_ignores_key_order(spark):
    left = spark.createDataFrame([(1, '{"a":1,"b":{"c":1,"d":2}}')], "k int, config string")
    right = spark.createDataFrame([(1, '{"b":{"d":2,"c":1},"a":2,"z":0}')], "k int, config string")
    got = {(r.path, r.left_value, r.right_value) for r in diff.config_diff(left, right, "k", "config").collect()}
    assert got == {("a", "1", "2"), ("z", None, "0")}


def test_keyed_diff_statuses(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "k int, v string")
    right = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c")], "k int, v string")
    got = {r.k: r.status for r in diff.keyed_diff(left, right, ["k"], ["v"]).collect()}
    assert got == {1: "unchanged", 2: "changed", 3: "missing_on_left", 4: "missing_on_right"}


def test_mask_secrets(spark):
    text = (
        '{"mode":"full","DB_Password":"p\\"w","nested":{"api_token":"t","n":1},"uri":"","password":7,'
        '"note":"the \\"password\\": \\"x\\" is text","token":null,"list":[{"secret":"s"}]}'
    )
    df = spark.createDataFrame([(text,)], "config string")
    got = df.select(runlog.mask_secrets("config").alias("c")).first().c
    assert got == (
        '{"mode":"full","DB_Password":"***","nested":{"api_token":"***","n":1},"uri":"","password":7,'
        '"note":"the \\"password\\": \\"x\\" is text","token":null,"list":[{"secret":"***"}]}'
    )


def test_retention_ranks_all_runs(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, "generate", "ok", day + datetime.timedelta(days=i), i == 3, False) for i in range(6)]
    df = spark.createDataFrame(rows, "run_id int, run_type string, status string, created_at timestamp_ntz, pinned boolean, archived boolean")
    now = F.lit("2024-01-07 00:00:00").cast("timestamp_ntz")
    got = runlog.retention_candidates(df, runlog.RetentionPolicy(2), now)
    assert sorted(r.run_id for r in got.collect()) == [0, 1, 2]
    old = runlog.retention_candidates(df, runlog.RetentionPolicy(100, 4.5), now)
    assert sorted(r.run_id for r in old.collect()) == [0, 1]


def test_pages_follow_each_other(spark):
    day = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, day + datetime.timedelta(days=i // 2)) for i in range(10)], "id int, at timestamp_ntz")
    first = runlog.page(df, "at", "id", 3).collect()
    second = runlog.page(df, "at", "id", 3, before=(first[-1].at, first[-1].id)).collect()
    assert [r.id for r in first + second] == [r.id for r in runlog.page(df, "at", "id", 6).collect()] == [8, 9, 6, 7, 4, 5]
    assert [r.id for r in runlog.page(df, "at", "id", 2, 3).collect()] == [7, 4]
