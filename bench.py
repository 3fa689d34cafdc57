"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rowloom import suite  # noqa: E402
from rowloom.operators.generate import generate_dataset  # noqa: E402
from rowloom.plans.scratch import scratch_path  # noqa: E402
from rowloom.plans.session import RECOMMENDED  # noqa: E402

HEADLINE = (
    "gen_typed_row", "gen_dataset", "assign_fk", "gen_events",
    "tag_cdc", "apply_messiness", "inject_anomalies", "to_layer", "gold_normalize",
    "table_profile", "duplicate_pk_rows", "ref_integrity", "rule_violations", "violation_samples",
    "run_suites", "quality_report", "pii_classify", "table_fingerprint", "schema_diff", "keyed_diff", "config_diff",
    "run_metrics", "run_timeline", "retention_candidates", "link_report", "json_contract",
    "sink_sql_insert", "stream_event_windows",
)
ROUNDS = 2


def throughput(spark: SparkSession, scale: int) -> dict[str, float]:
    """Rows per second of generating a three-table dataset and of exporting it as Parquet."""
    from rowloom.suite.generation import SHOP

    made = generate_dataset(spark, SHOP, scale, 42)
    rows, rates = 6 * scale, {}
    for step in ("generate", "generate_and_export"):
        started = time.perf_counter()
        for name, df in made.items():
            if step == "generate":
                df.write.format("noop").mode("overwrite").save()
            else:
                df.write.parquet(scratch_path(spark, f"bench-{name}"))
        rates[step] = round(rows / (time.perf_counter() - started))
    return rates


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
    for name, value in RECOMMENDED.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    registry = suite.load()

    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(ROUNDS):
            started = time.perf_counter()
            registry[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            seconds = time.perf_counter() - started
            best = seconds if best is None else min(best, seconds)
        times[name] = round(best, 3)
    rates = throughput(spark, int(os.environ.get("BENCH_SCALE", "1000000")))
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
        "rows_per_sec": rates,
    }))


if __name__ == "__main__":
    main()
