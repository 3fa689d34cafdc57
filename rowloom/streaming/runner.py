"""Running bounded streams: file source in, Parquet sink out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from rowloom.plans.scratch import scratch_path


def stream_table(spark: SparkSession, folder: str, table: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table as a stream; its schema is taken from the files, not inferred per batch."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # A glob, as it takes a single file as well as a folder of part files.
    return reader.parquet(f"{folder}/{{{table}}}.parquet")


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Cast a time without zone, as watermarks need an instant."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def run_available(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Process everything available, then return what was written so far.

    With a ``folder`` of its own a query that is run again goes on where it stopped; the
    sink keeps each batch exactly once. Otherwise a new scratch folder is used.
    """
    spark = df.sparkSession
    folder = folder or scratch_path(spark, label)
    out, progress = f"{folder}/data", f"{folder}/progress"
    query = (
        df.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", progress)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(df.schema).parquet(out)


#: The batch that wrote a row; a batch that is repeated after a failure overwrites what it wrote before.
BATCH = "_batch"


def run_batches(
    df: DataFrame, step: Callable[[DataFrame], DataFrame], label: str, folder: str | None = None, mode: str = "append",
) -> DataFrame:
    """Process everything available batch by batch: ``step`` gets each micro-batch as a plain table.

    So a step can count keys, broadcast and write more than once, which a streaming plan can't. The result holds what all batches
    wrote, with the batch number in ``_batch``. Each batch has a folder of its own, so a repeated one changes nothing.
    With a ``folder`` of its own a query that is run again goes on where it stopped.
    """
    spark = df.sparkSession
    folder = folder or scratch_path(spark, label)
    out = f"{folder}/data"
    # So that there is a table, and a schema, before any batch.
    step(spark.createDataFrame([], df.schema)).write.mode("overwrite").parquet(f"{out}/{BATCH}=-1")

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/{BATCH}={number}")

    query = (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/progress")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.parquet(out)


def run_updates(df: DataFrame, key: Sequence[str], label: str, folder: str | None = None) -> DataFrame:
    """Run an aggregation in update mode and return the newest row of every key.

    A batch writes only the keys it changed; of these the row of the last batch counts.
    """
    written = run_batches(df, lambda batch: batch, label, folder, "update")
    rest = [c for c in df.columns if c not in key]
    newest = written.groupBy(*key).agg(F.max_by(F.struct(*rest), BATCH).alias("_row"))
    return newest.select(*[F.col(c) if c in key else F.col("_row")[c].alias(c) for c in df.columns])


def run_observed(df: DataFrame, label: str, folder: str | None = None) -> tuple[DataFrame, list[dict]]:
    """Like ``run_available``, and for each batch what ``DataFrame.observe`` measured while it ran.

    ``late_dropped`` counts rows that stateful operators dropped behind the watermark. Progress is read while the query runs, since Spark
    keeps the last hundred batches only.
    """
    spark = df.sparkSession
    folder = folder or scratch_path(spark, label)
    query = (
        df.writeStream.format("parquet").option("path", f"{folder}/data").option("checkpointLocation", f"{folder}/progress")
        .outputMode("append").trigger(availableNow=True).start()
    )
    seen: dict[int, dict] = {}
    try:
        while not query.awaitTermination(1):
            _note(query, seen)
        _note(query, seen)
    finally:
        query.stop()
    return spark.read.schema(df.schema).parquet(f"{folder}/data"), [seen[k] for k in sorted(seen)]


def _note(query: StreamingQuery, seen: dict[int, dict]) -> None:
    for progress in query.recentProgress:
        measured = {k: v for row in progress.observedMetrics.values() for k, v in row.asDict().items()}
        dropped = sum(o.numRowsDroppedByWatermark for o in progress.stateOperators)
        # A batch can report more than once, the last report being the whole of it.
        seen[progress.batchId] = {"batch": progress.batchId, "rows": progress.numInputRows, "late_dropped": dropped, **measured}
