"""Registered queries of this subpackage and their SQL twins: the operators with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import (
    decontaminate, filter_audit, langid, license_scan, line_dedup, mixing, nearest, ngram_join, periodic_runs, quality,
    substring_dedup, token_count, toxicity,
)
from rowloom.llm.common import table


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join_similar(table(spark, folder, "documents"))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, folder, "documents"))


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.license_digest(table(spark, folder, "documents"))


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_count.count_tokens(table(spark, folder, "documents"))


def op9_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify_languages(table(spark, folder, "documents"))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.run_digest(periodic_runs.with_repeated_tails(table(spark, folder, "documents")))


def op13_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.substring_digest(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_mixing, op3_decontamination, op4_line_dedup, op5_license_scan, op6_quality_classifier,
        op7_toxicity, op8_token_counts, op9_nearest_neighbours, op10_language_id, op11_filter_audit, op12_periodic_runs, op13_substring_dedup,
    )
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_join.ORACLE, "op2_mixing": mixing.ORACLE, "op4_line_dedup": line_dedup.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE, "op13_substring_dedup": substring_dedup.ORACLE,
}
