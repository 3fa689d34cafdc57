"""Scans, samples, counts and structural findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators.lint import schema_lint
from rowloom.operators.profile import row_counts
from rowloom.operators.selection import head_sample
from rowloom.plans.catalog import counted_catalog, union_all
from rowloom.plans.scratch import scratch_path
from rowloom.sources import readers, writers
from rowloom.suite.registry import TABLES, query, table, tables

ORDER_TEXT = """
SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus,
       o_totalprice::VARCHAR AS o_totalprice,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, o_orderpriority,
       CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'note "' || o_orderstatus || '", kept' END AS note
FROM orders"""


def _orders_with_note(spark: SparkSession, folder: str) -> DataFrame:
    note = F.when(F.col("o_orderstatus") != "F", F.concat(F.lit('note "'), "o_orderstatus", F.lit('", kept')))
    return table(spark, folder, "orders").withColumn("note", note)


@query("scan_csv", ORDER_TEXT)
def scan_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = writers.write_csv(_orders_with_note(spark, folder), scratch_path(spark, "csv"))
    return readers.scan_csv(spark, path)


@query("scan_json", "SELECT * FROM orders")
def scan_json(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    path = writers.write_json_array(orders, scratch_path(spark, "json"))
    return readers.scan_json(spark, path, orders.schema)


@query("scan_jsonl", "SELECT * FROM events")
def scan_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    path = writers.write_jsonl(events, scratch_path(spark, "jsonl"))
    return readers.scan_jsonl(spark, path, events.schema)


@query("scan_parquet", "SELECT * FROM lineitem")
def scan_parquet(spark: SparkSession, folder: str) -> DataFrame:
    return readers.scan_parquet(spark, f"{folder}/lineitem.parquet")


COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES)


@query(
    "dataset_catalog",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, 'parquet' AS format, {len(c)} AS column_count, count(*) AS row_count FROM {t}"
        for t, c in TABLES.items()
    ),
)
def dataset_catalog(spark: SparkSession, folder: str) -> DataFrame:
    found = readers.list_tables(spark, folder)
    parts = []
    for name, (path, kind) in found.items():
        df = readers.scan(spark, path, kind)
        parts.append(
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"), F.lit(kind).alias("format"),
                F.lit(len(df.columns)).alias("column_count"), "row_count",
            )
        )
    return union_all(parts).filter("row_count > 0")


@query("table_row_counts", COUNTS)
def table_row_counts(spark: SparkSession, folder: str) -> DataFrame:
    return row_counts(tables(spark, folder))


@query(
    "sample_rows",
    "SELECT *, (SELECT count(*) FROM orders) > 20 AS truncated FROM orders ORDER BY o_orderkey LIMIT 20",
)
def sample_rows(spark: SparkSession, folder: str) -> DataFrame:
    return head_sample(table(spark, folder, "orders"), "o_orderkey", 20)


LINT_TABLES = ("orders", "lineitem", "customer", "nation")
LINT_KEYS = [("orders", "o_orderkey"), ("lineitem", "l_lineid"), ("customer", "c_custkey")]
LINT_LINKS = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("orders", "o_clerkkey", "clerk", "k_clerkkey"),
    ("customer", "c_nationkey", "nation", "n_id"),
    ("nation", "n_nationkey", "nation", "n_nationkey"),
]


@query(
    "schema_lint",
    f"""
WITH sizes AS ({' UNION ALL '.join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in LINT_TABLES)}),
found(finding, table_name, subject, fix) AS (VALUES
  ('duplicate_column', 'nation', 'n_name', 'rename or remove the column'),
  ('dangling_key', 'lineitem', 'l_lineid', 'add the column or drop it from the key'),
  ('dangling_link_column', 'orders', 'o_clerkkey', 'add the column or fix the link'),
  ('dangling_parent_table', 'clerk', 'k_clerkkey', 'create the table or fix the link'),
  ('dangling_parent_column', 'nation', 'n_id', 'add the column or fix the link'),
  ('self_reference', 'nation', 'n_nationkey', 'check that the self-reference is meant'))
SELECT finding, table_name, subject, fix, coalesce(n, 0) AS affected_rows
FROM found LEFT JOIN sizes ON t = table_name""",
)
def lint(spark: SparkSession, folder: str) -> DataFrame:
    catalog = counted_catalog(tables(spark, folder, *LINT_TABLES))
    twice = catalog.filter("table_name = 'nation' AND column_name = 'n_name'")
    keys = spark.createDataFrame(LINT_KEYS, "table_name string, column_name string")
    links = spark.createDataFrame(
        LINT_LINKS, "table_name string, column_name string, parent_table string, parent_column string"
    )
    return schema_lint(catalog.unionByName(twice), keys, links)
