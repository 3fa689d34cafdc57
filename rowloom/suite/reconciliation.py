"""Manifests, fingerprints, reconciliation and diffs on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators import diff, drift, reconcile
from rowloom.operators.profile import row_counts
from rowloom.plans.catalog import counted_catalog, schema_catalog, union_all
from rowloom.plans.scratch import scratch_path
from rowloom.sources.writers import write_parquet
from rowloom.suite.registry import TABLES, catalog_sql, query, table, tables


@query(
    "build_manifest",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, 42 AS seed, 'full_snapshot' AS mode, 'bronze' AS layer FROM {t}"
        for t in TABLES
    ),
)
def build_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.build_manifest(tables(spark, folder), 42, "full_snapshot", "bronze")


def _signature_sql(name: str, columns: dict[str, str], source: str) -> str:
    text = "|".join([name, *[f"{c}:{k}" for c, k in columns.items()]])
    return f"SELECT '{name}' AS table_name, substr(sha256('{text}'), 1, 16) AS signature, count(*) AS row_count FROM {source}"


@query("schema_signature", " UNION ALL ".join(_signature_sql(t, c, t) for t, c in TABLES.items()))
def schema_signature(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.schema_signature(counted_catalog(tables(spark, folder)))


PRINTED = ("customer", "orders", "lineitem", "part")


def _fingerprint_sql(name: str) -> str:
    cells = " || '|' || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in TABLES[name])
    return (
        f"SELECT '{name}' AS table_name, count(*) AS row_count, "
        f"sum(('0x' || substr(d, 1, 8))::BIGINT)::VARCHAR AS digest_sum, "
        f"bit_xor(('0x' || substr(d, 9, 15))::BIGINT) AS digest_xor FROM (SELECT md5({cells}) AS d FROM {name})"
    )


@query("table_fingerprint", " UNION ALL ".join(map(_fingerprint_sql, PRINTED)))
def table_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return union_all([reconcile.table_fingerprint(df, t) for t, df in tables(spark, folder, *PRINTED).items()])


# A later delivery: pending orders are gone, customers have a text key, parts are missing, nations are new

def _delivered(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    found = tables(spark, folder, "orders", "customer", "supplier", "nation")
    found["orders"] = drift.rename_column(
        found["orders"].filter("o_orderstatus <> 'P'"), "o_orderdate", "o_orderdate_renamed"
    )
    found["customer"] = drift.change_type(found["customer"], "c_nationkey", "string")
    return found


def _promised(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return tables(spark, folder, "orders", "customer", "supplier", "part")


def _signed(of: dict[str, DataFrame]) -> DataFrame:
    return reconcile.schema_signature(counted_catalog(of))


@query(
    "manifest_check",
    """SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS expected_rows,
      (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS actual_rows, 'row count mismatch' AS status
    UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer), 'signature mismatch'
    UNION ALL SELECT 'supplier', (SELECT count(*) FROM supplier), (SELECT count(*) FROM supplier), 'ok'
    UNION ALL SELECT 'part', (SELECT count(*) FROM part), NULL, 'no data found'
    UNION ALL SELECT 'nation', NULL, (SELECT count(*) FROM nation), 'not in manifest'""",
)
def manifest_check(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.manifest_check(_signed(_promised(spark, folder)), _signed(_delivered(spark, folder)))


@query(
    "reconcile_counts",
    """SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS expected_rows,
      (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS actual_rows, false AS missing
    UNION ALL SELECT 'part', (SELECT count(*) FROM part), 0, true""",
)
def reconcile_counts(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.reconcile_counts(row_counts(_promised(spark, folder)), row_counts(_delivered(spark, folder)))


@query(
    "missing_columns",
    f"""SELECT table_name, column_name, ordinal, data_type, row_count
    FROM ({catalog_sql('orders', 'customer', 'supplier', 'part')})
    WHERE table_name = 'part' OR (table_name = 'orders' AND column_name = 'o_orderdate')""",
)
def missing_columns(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.missing_columns(
        counted_catalog(_promised(spark, folder)), counted_catalog(_delivered(spark, folder))
    )


@query(
    "run_reconciliation",
    """SELECT 'row_count_diff' AS finding, 'orders' AS table_name, '' AS detail,
       (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') - (SELECT count(*) FROM orders) AS amount
    UNION ALL SELECT 'missing_table', 'part', '', -(SELECT count(*) FROM part)
    UNION ALL SELECT 'missing_column', 'orders', 'o_orderdate', 1
    UNION ALL SELECT * FROM (SELECT 'duplicate_primary_key', 'customer', '', count(*) AS n FROM
      (SELECT 1 FROM customer GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 1)) WHERE n > 0""",
)
def run_reconciliation(spark: SparkSession, folder: str) -> DataFrame:
    promised, delivered = _promised(spark, folder), _delivered(spark, folder)
    return reconcile.run_reconciliation(
        row_counts(promised), counted_catalog(promised), delivered, counted_catalog(delivered),
        {"orders": ["o_orderkey"], "customer": ["c_nationkey", "c_mktsegment"]},
    )


@query(
    "load_check",
    """SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS source_rows,
      (SELECT count(*) FROM orders) AS loaded_rows, false AS missing, true AS matches
    UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer WHERE c_acctbal > 0),
      false, false
    UNION ALL SELECT 'part', (SELECT count(*) FROM part), 0, true, false""",
)
def load_check(spark: SparkSession, folder: str) -> DataFrame:
    source = tables(spark, folder, "orders", "customer", "part")
    sent = {"orders": source["orders"], "customer": source["customer"].filter("c_acctbal > 0")}
    loaded = {t: spark.read.parquet(write_parquet(df, scratch_path(spark, f"load-{t}"))) for t, df in sent.items()}
    return reconcile.load_check(source, loaded)


CHANGES = """SELECT * FROM (VALUES
    ('table_removed', 'part', NULL, NULL, NULL), ('table_added', 'nation', NULL, NULL, NULL),
    ('column_removed', 'orders', 'o_orderdate', 'timestamp_ntz', NULL),
    ('column_added', 'orders', 'o_orderdate_renamed', NULL, 'timestamp_ntz'),
    ('column_type_changed', 'customer', 'c_nationkey', 'int', 'string'))
    AS v(change, table_name, column_name, from_type, to_type)"""


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    return diff.schema_diff(schema_catalog(_promised(spark, folder)), schema_catalog(_delivered(spark, folder)))


@query("schema_diff", CHANGES)
def schema_diff(spark: SparkSession, folder: str) -> DataFrame:
    return _changes(spark, folder)


@query("schema_compat", "SELECT 4 AS breaking_count, 3 AS non_breaking_count, 'breaking' AS status")
def schema_compat(spark: SparkSession, folder: str) -> DataFrame:
    left = spark.createDataFrame([("orders:o_custkey->customer:c_custkey",), ("part:p_s->supplier:s",)], "relationship string")
    right = spark.createDataFrame([("orders:o_custkey->customer:c_custkey",), ("supplier:s_n->nation:n",)], "relationship string")
    changes = _changes(spark, folder).select("change").unionByName(diff.relationship_diff(left, right).select("change"))
    return diff.compatibility(changes).withColumns(
        {c: F.col(c).cast("int") for c in ("breaking_count", "non_breaking_count")}
    )


# Two versions of a configuration per event

LEFT_CONFIG = """to_json(named_struct('k', k, 'mode', event_type, 'sim', named_struct('enabled', true, 'pattern', 'steady'),
    'deep', named_struct('a', named_struct('b', k)), 'tags', array(1, 2)))"""
RIGHT_CONFIG = """to_json(named_struct('k', if(value > 20, k + 1, k), 'mode', event_type,
    'sim', named_struct('enabled', value < 50, 'pattern', if(k > 50, 'burst', 'steady')),
    'deep', named_struct('a', named_struct('b', if(k < 10, 0, k))), 'extra', if(k > 90, 'x', null),
    'tags', if(k = 5, array(1), array(1, 2))))"""


@query(
    "config_diff",
    """WITH e AS (SELECT event_id, value, json_extract(props, '$.k')::INTEGER AS k FROM events)
    SELECT event_id, 'k' AS path, k::VARCHAR AS left_value, (k + 1)::VARCHAR AS right_value FROM e WHERE value > 20
    UNION ALL SELECT event_id, 'sim.enabled', 'true', 'false' FROM e WHERE NOT value < 50
    UNION ALL SELECT event_id, 'sim.pattern', '"steady"', '"burst"' FROM e WHERE k > 50
    UNION ALL SELECT event_id, 'deep', '{"a":{"b":' || k || '}}', '{"a":{"b":0}}' FROM e WHERE k < 10 AND k <> 0
    UNION ALL SELECT event_id, 'extra', NULL, '"x"' FROM e WHERE k > 90
    UNION ALL SELECT event_id, 'tags', '[1,2]', '[1]' FROM e WHERE k = 5""",
)
def config_diff(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    left = events.select("event_id", F.expr(LEFT_CONFIG).alias("config"))
    right = events.select("event_id", F.expr(RIGHT_CONFIG).alias("config"))
    return diff.config_diff(left, right, "event_id", "config")


# Two versions of orders: cheap ones were dropped, urgent ones repriced, finished ones lost their customer

FIELDS = ("o_custkey", "o_orderstatus", "o_totalprice")
NEXT_SQL = """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS o_custkey, o_orderstatus,
    CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
    FROM orders WHERE o_totalprice > 20000"""
FIELD_DIFF = " UNION ALL ".join(
    f"""SELECT o_orderkey, '{c}' AS field, l.{c}::VARCHAR AS left_value, r.{c}::VARCHAR AS right_value,
    CASE WHEN l.{c} IS NULL AND r.{c} IS NOT NULL THEN 'missing_on_left' WHEN l.{c} IS NOT NULL AND r.{c} IS NULL
    THEN 'missing_on_right' WHEN l.{c} IS NOT DISTINCT FROM r.{c} THEN 'unchanged' ELSE 'changed' END AS status
    FROM (SELECT * FROM orders WHERE o_orderpriority <> '5-LOW' OR o_totalprice < 400000) l
    FULL JOIN ({NEXT_SQL}) r USING (o_orderkey)"""
    for c in FIELDS
)


def _field_diff(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    before = orders.filter("o_orderpriority <> '5-LOW' OR o_totalprice < 400000")
    price = F.col("o_totalprice")
    after = orders.filter(price > 20000).withColumns(
        {
            "o_custkey": F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")),
            "o_totalprice": F.when(F.col("o_orderpriority") == "1-URGENT", price + 1).otherwise(price),
        }
    )
    return diff.keyed_diff(before, after, ["o_orderkey"], FIELDS)


@query("keyed_diff", FIELD_DIFF)
def keyed_diff(spark: SparkSession, folder: str) -> DataFrame:
    return _field_diff(spark, folder)


@query("keyed_diff_summary", f"SELECT field, status, count(*) AS rows FROM ({FIELD_DIFF}) GROUP BY ALL")
def keyed_diff_summary(spark: SparkSession, folder: str) -> DataFrame:
    return diff.diff_summary(_field_diff(spark, folder))
