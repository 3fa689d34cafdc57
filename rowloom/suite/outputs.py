"""Sinks: written, read back and compared. Database loads need a database and are not registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.plans.catalog import union_all
from rowloom.plans.scratch import scratch_path
from rowloom.sources import readers, writers
from rowloom.suite.degradation import BRONZE, bronze_orders
from rowloom.suite.registry import query, table, tables

NULLED = "CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name END"


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").withColumn("c_name", F.expr(NULLED))


@query(
    "sink_csv",
    f"""SELECT c_custkey::VARCHAR AS c_custkey, coalesce({NULLED}, '') AS c_name, c_nationkey::VARCHAR AS c_nationkey,
    c_acctbal::VARCHAR AS c_acctbal, c_mktsegment FROM customer""",
)
def sink_csv(spark: SparkSession, folder: str) -> DataFrame:
    return readers.scan_csv(spark, writers.write_csv(_customers(spark, folder), scratch_path(spark, "csv")))


def _round_trip(name: str, kind: str) -> None:
    @query(name, f"SELECT * REPLACE ({NULLED} AS c_name) FROM customer")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        customers = _customers(spark, folder)
        path = writers.write_table(customers, scratch_path(spark, kind), kind)
        if kind == "json":
            return readers.scan_json(spark, path, customers.schema)
        if kind == "jsonl":
            return readers.scan_jsonl(spark, path, customers.schema)
        return readers.scan_parquet(spark, path)


_round_trip("sink_json", "json")
_round_trip("sink_jsonl", "jsonl")
_round_trip("sink_parquet", "parquet")


@query(
    "sink_sql_insert",
    """SELECT 'INSERT INTO part (p_partkey, p_name, p_retailprice, big, cheap) VALUES (' || p_partkey || ', ' ||
    CASE WHEN p_size > 25 THEN '''it''''s \\\\ ' || p_name || '''' ELSE 'NULL' END || ', ' || p_retailprice || ', ' ||
    CASE WHEN p_size > 25 THEN 'TRUE' ELSE 'FALSE' END || ', ' ||
    CASE WHEN p_size > 40 THEN 'NULL' WHEN p_retailprice < 1000 THEN 'TRUE' ELSE 'FALSE' END || ');' AS value FROM part""",
)
def sink_sql_insert(spark: SparkSession, folder: str) -> DataFrame:
    big, cheap = F.col("p_size") > 25, F.col("p_retailprice") < 1000
    parts = table(spark, folder, "part").select(
        "p_partkey",
        F.when(big, F.concat(F.lit("it's \\ "), "p_name")).alias("p_name"),
        "p_retailprice",
        big.alias("big"),
        F.when(F.col("p_size") <= 40, cheap).alias("cheap"),
    )
    return spark.read.text(writers.write_sql(parts, "part", scratch_path(spark, "sql")))


@query(
    "sink_layers",
    f"""{BRONZE} SELECT 'bronze' AS layer, count(*) AS row_count, count(DISTINCT o_orderdate) AS dates,
      sum(length(o_orderstatus))::BIGINT AS status_length FROM bronze
    UNION ALL SELECT 'silver', count(*), count(DISTINCT o_orderdate), sum(length(o_orderstatus))::BIGINT FROM silver
    UNION ALL SELECT 'gold', count(*), count(DISTINCT o_orderdate), sum(length(o_orderstatus))::BIGINT FROM gold""",
)
def sink_layers(spark: SparkSession, folder: str) -> DataFrame:
    bronze = bronze_orders(spark, folder)
    paths = writers.write_layers(bronze, scratch_path(spark, "layers"), "orders", "o_orderkey", "arrival")
    return union_all(
        [
            readers.scan_parquet(spark, path).agg(
                F.lit(layer).alias("layer"),
                F.count(F.lit(1)).alias("row_count"),
                F.countDistinct("o_orderdate").alias("dates"),
                F.sum(F.length("o_orderstatus")).alias("status_length"),
            )
            for layer, path in paths.items()
        ]
    )


@query(
    "sink_seeds",
    """SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_nationkey::VARCHAR AS s_nationkey, s_acctbal::VARCHAR AS s_acctbal,
      '' AS rating FROM supplier
    UNION ALL SELECT s_suppkey::VARCHAR, '', '', s_acctbal::VARCHAR, 'good' FROM supplier WHERE s_acctbal > 5000""",
)
def sink_seeds(spark: SparkSession, folder: str) -> DataFrame:
    t = tables(spark, folder, "supplier")["supplier"]
    rated = t.filter("s_acctbal > 5000").select("s_suppkey", "s_acctbal", F.lit("good").alias("rating"))
    written = writers.write_seeds({"supplier": [t, rated], "nobody": [t.filter("s_acctbal IS NULL")]}, scratch_path(spark, "seeds"))
    if set(written) != {"supplier"}:
        raise AssertionError(f"unexpected seed files {sorted(written)}")
    return readers.scan_csv(spark, written["supplier"])
