"""Run-log analytics, on a log with one run per given event."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators import runlog
from rowloom.suite.registry import query, table

RUN_COLUMNS = [
    "event_id AS run_id",
    "CASE event_type WHEN 'view' THEN 'generate' WHEN 'click' THEN 'validate' WHEN 'signup' THEN 'benchmark' "
    "WHEN 'error' THEN 'generate' END AS run_type",
    "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' WHEN 'view' THEN 'succeeded' "
    "WHEN 'click' THEN 'succeeded' END AS status",
    "ts AS created_at",
    "value AS duration_seconds",
    "k < 7 AS pinned",
    "value < 3 AS archived",
    "CASE WHEN k < 50 THEN 'ecommerce' WHEN k < 80 THEN 'saas_billing' END AS pack",
    "user_id AS scenario_id",
    "k",
    "value",
]

CONFIG = (
    "'{\"mode\":\"' || CASE WHEN k > 40 THEN 'cdc' ELSE 'full' END || '\",\"layer\":\"bronze\",\"pack\":\"fallback\"' || "
    "CASE WHEN k > 60 THEN ',\"custom_schema_id\":\"schema_' || k || '\"' ELSE '' END || "
    "',\"db\":{\"Password\":\"p' || k || '\",\"port\":5432,\"uri\":\"\"},\"api_token\":\"t\"}'"
)


def runs(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))

    def stage(name: str, share: str, status: str) -> str:
        return f"named_struct('name', '{name}', 'status', {status}, 'duration_seconds', value * {share})"

    return events.selectExpr(*RUN_COLUMNS).withColumns(
        {
            "config": F.expr(CONFIG),
            "summary": F.expr(
                "named_struct('total_rows', CASE WHEN k < 30 THEN k * 10 END, 'total_rows_generated', "
                "CASE WHEN k < 60 THEN k * 100 END, 'rows_generated', k)"
            ),
            "stages": F.expr(
                "array(" + ", ".join(
                    [
                        stage("load", "0.25D", "'completed'"),
                        stage("generate", "CASE WHEN k > 30 THEN 0.6D ELSE 0.3D END", "'completed'"),
                        stage("export", "0.45D", "CASE WHEN k < 20 THEN 'skipped' ELSE 'failed' END"),
                    ]
                ) + ")"
            ),
            "error_message": F.expr("CASE WHEN status = 'failed' AND k > 9 THEN 'cause ' || (k / 10)::INT || '\\nat line 1' END"),
        }
    )


RUNS = f"""WITH e AS (SELECT *, json_extract(props, '$.k')::INTEGER AS k FROM events),
    runs AS (SELECT {", ".join(RUN_COLUMNS)}, {CONFIG} AS config FROM e)"""


@query(
    "run_metrics",
    f"""{RUNS}
    SELECT 'runs_by_type' AS metric, coalesce(run_type, 'generate') AS label, count(*)::DOUBLE AS value FROM runs GROUP BY 2
    UNION ALL SELECT 'runs_by_status', coalesce(status, 'unknown'), count(*)::DOUBLE FROM runs GROUP BY 2
    UNION ALL SELECT 'failures', CASE WHEN k > 9 THEN 'cause ' || (k // 10) ELSE 'unknown' END, count(*)::DOUBLE FROM runs
      WHERE status = 'failed' GROUP BY 2
    UNION ALL SELECT 'total_runs', 'all', count(*)::DOUBLE FROM runs
    UNION ALL SELECT 'total_rows', 'all', sum(CASE WHEN k < 30 THEN k * 10 WHEN k < 60 THEN k * 100 ELSE k END)::DOUBLE FROM runs
    UNION ALL SELECT 'average_duration_seconds', 'all', floor(sum(duration_seconds::DECIMAL(28,6))::DOUBLE
      / count(duration_seconds)::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE FROM runs""",
)
def run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return runlog.run_metrics(runs(spark, folder))


@query(
    "run_timeline",
    f"""{RUNS}, s AS (SELECT *, value * 0.25::DOUBLE AS load, value * CASE WHEN k > 30 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS gen,
        CASE WHEN k >= 20 THEN value * 0.45::DOUBLE END AS export FROM runs),
    t AS (SELECT *, greatest(load, gen, coalesce(export, 0)) AS top FROM s),
    n AS (SELECT *, CASE WHEN top > 0 THEN CASE top WHEN load THEN 'load' WHEN gen THEN 'generate' ELSE 'export' END END AS slowest_stage,
      CASE WHEN top > 0 THEN top END AS slowest_seconds,
      CASE WHEN top > 0 AND duration_seconds > 0 THEN floor(100.0::DOUBLE * top / duration_seconds + 0.5::DOUBLE)::INTEGER END AS pct FROM t)
    SELECT run_id, status, run_type, duration_seconds, CASE WHEN k < 20 THEN 2 ELSE 3 END AS timed_stages, slowest_stage,
      slowest_seconds, pct AS slowest_percent,
      CASE WHEN pct >= 50 THEN slowest_stage || ' took ' || pct || '% of total time' END AS why_slow_hint FROM n""",
)
def run_timeline(spark: SparkSession, folder: str) -> DataFrame:
    return runlog.run_timeline(runs(spark, folder))


POLICY = runlog.RetentionPolicy(500, 20.0, True, ("running",), ("benchmark",))


@query(
    "retention_candidates",
    f"""{RUNS}, r AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, run_id) AS nr,
      (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(created_at))::DOUBLE / 86400000000.0::DOUBLE AS age_days FROM runs)
    SELECT run_id, run_type, status, created_at, age_days FROM r WHERE NOT pinned AND NOT archived
    AND coalesce(status, '') <> 'running' AND coalesce(run_type, '') <> 'benchmark' AND (nr > 500 OR age_days > 20)""",
)
def retention_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return runlog.retention_candidates(runs(spark, folder), POLICY, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))


SHOWN = ["run_id", "run_type", "status", "created_at", "duration_seconds", "archived"]
PAGE = f"""{RUNS} SELECT {', '.join(SHOWN)} FROM runs WHERE status = 'succeeded' AND run_type = 'generate'
    AND k > 40 AND NOT archived """


@query("run_search", PAGE + "ORDER BY created_at DESC, run_id LIMIT 25 OFFSET 50")
def run_search(spark: SparkSession, folder: str) -> DataFrame:
    found = runlog.search_runs(
        runs(spark, folder), {"status": "succeeded", "run_type": "generate"}, {"mode": "cdc"}, False, 25, 50
    )
    return found.select(*SHOWN)


@query(
    "run_search_cursor",
    PAGE + "AND (created_at, -run_id) < (TIMESTAMP '2024-01-15', 0) ORDER BY created_at DESC, run_id LIMIT 25",
)
def run_search_cursor(spark: SparkSession, folder: str) -> DataFrame:
    at = datetime.datetime(2024, 1, 15)
    log = runs(spark, folder)
    found = runlog.search_runs(
        log, {"status": "succeeded", "run_type": "generate"}, {"mode": "cdc"}, False, 25, before=(at, 0)
    )
    return found.select(*SHOWN)


@query(
    "mask_config",
    f"""{RUNS} SELECT run_id, '{{"mode":"' || CASE WHEN k > 40 THEN 'cdc' ELSE 'full' END
    || '","layer":"bronze","pack":"fallback"' || CASE WHEN k > 60 THEN ',"custom_schema_id":"schema_' || k || '"' ELSE '' END
    || ',"db":{{"Password":"***","port":5432,"uri":""}},"api_token":"***"}}' AS config FROM runs""",
)
def mask_config(spark: SparkSession, folder: str) -> DataFrame:
    return runs(spark, folder).select("run_id", runlog.mask_secrets("config").alias("config"))


@query(
    "text_search",
    """SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND list_contains([source, lang], 'src8')
    AND (contains(lower(text), 'then') OR contains(lower(source), 'then')) ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 3""",
)
def text_search(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").withColumn("tags", F.array("source", "lang"))
    found = runlog.search_text(documents, "THEN", ["text", "source"], ("lang", "en"), ("tags", "src8"))
    return runlog.page(found, "n_chars", "doc_id", 20, 3).select("doc_id", "lang", "source", "n_chars")


@query(
    "run_lineage",
    f"""{RUNS}, scenarios AS (SELECT user_id AS scenario_id, 'scenario ' || user_id AS name, count(*)::INTEGER AS version
      FROM events GROUP BY user_id),
    schemas AS (SELECT 'schema_' || c_custkey AS schema_id FROM customer)
    SELECT run_id, run_type, runs.scenario_id, s.name AS scenario_name, s.version AS scenario_version,
      coalesce(pack, 'fallback') AS pack, CASE WHEN k > 60 THEN 'schema_' || k END AS custom_schema_id,
      CASE WHEN k > 60 THEN 'custom_schema' ELSE 'pack' END AS schema_source,
      k > 60 AND schema_id IS NULL AS schema_missing
    FROM runs LEFT JOIN scenarios s ON s.scenario_id = runs.scenario_id
    LEFT JOIN schemas ON schema_id = CASE WHEN k > 60 THEN 'schema_' || k END""",
)
def run_lineage(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    scenarios = (
        events.groupBy(F.col("user_id").alias("scenario_id"))
        .agg(F.count(F.lit(1)).cast("int").alias("version"))
        .withColumn("name", F.concat(F.lit("scenario "), F.col("scenario_id").cast("string")))
    )
    schemas = (
        table(spark, folder, "customer")
        .select(F.concat(F.lit("schema_"), F.col("c_custkey").cast("string")).alias("schema_id"))
    )
    return runlog.run_lineage(runs(spark, folder), scenarios, schemas)
