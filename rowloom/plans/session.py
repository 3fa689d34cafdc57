"""Session settings that suit these operators."""

from __future__ import annotations

# Shuffle partition numbers are left to adaptive execution: start high, coalesce down.
RECOMMENDED: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Call sites in error messages cost a stack walk per column expression while plans are built.
    "spark.sql.dataFrameQueryContext.enabled": "false",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.parquet.filterPushdown": "true",
    # The JVM does not compile methods above 8,000 bytes; wide generated projections are
    # faster as several small methods than as one whole-stage method that stays interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
