"""Load metadata of incremental and change-data-capture feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions import rng

# First load time and seconds between two rows.
FIRST_LOAD = "2024-01-01 00:00:00"
SECONDS_PER_ROW = 17
OPERATIONS = ("INSERT", "UPDATE", "DELETE")


def _load_time(index: Column, seed: int) -> Column:
    seconds = index.cast("bigint") * SECONDS_PER_ROW + seed
    days = F.floor(seconds / F.lit(86_400)).cast("int")
    return F.to_timestamp_ntz(F.lit(FIRST_LOAD)) + F.make_dt_interval(
        days=days, secs=(seconds - days.cast("bigint") * 86_400).cast("decimal(12,6)")
    )


def _later(time: Column, hours: int) -> Column:
    return time + F.make_dt_interval(hours=F.lit(hours))


def tag_incremental(
    df: DataFrame, index: str, changed: Column, seed: int, batch_id: str | None = None
) -> DataFrame:
    """Add ``created_at``, ``updated_at`` and ``batch_id``; changed rows are touched an hour later."""
    created = _load_time(F.col(index), seed)
    return df.withColumns(
        {
            "created_at": created,
            "updated_at": F.when(changed, _later(created, 1)).otherwise(created),
            "batch_id": F.lit(batch_id or f"batch_{seed}"),
        }
    )


def tag_cdc(
    df: DataFrame, index: str, changed: Column, seed: int, table: str, batch_id: str | None = None
) -> DataFrame:
    """Add the incremental columns, ``op_type`` and a ``deleted_at`` that is null unless deleted."""
    created = _load_time(F.col(index), seed)
    roll = rng.randint(seed, f"{table}.cdc.op", index, 0, 99)
    marked = df.withColumns(
        {
            "created_at": created,
            "batch_id": F.lit(batch_id or f"batch_{seed}"),
            "op_type": F.when(~changed | (roll < 70), F.lit("INSERT"))
            .when(roll < 90, F.lit("UPDATE"))
            .otherwise(F.lit("DELETE")),
        }
    )
    op = F.col("op_type")
    return marked.withColumns(
        {
            "updated_at": F.when(op == "UPDATE", _later(F.col("created_at"), 2)).otherwise(F.col("created_at")),
            "deleted_at": F.when(op == "DELETE", _later(F.col("created_at"), 3)),
        }
    )


def invalid_operation(op_column: str) -> Column:
    """True for an operation outside the known ones; a missing operation is allowed."""
    op = F.col(op_column)
    return op.isNotNull() & ~op.isin(*OPERATIONS)


def invalid_operations(df: DataFrame, op_column: str = "op_type") -> DataFrame:
    """Rows, invalid operations and the verdict."""
    return df.agg(
        F.count(F.lit(1)).alias("rows_checked"), F.count_if(invalid_operation(op_column)).alias("invalid_ops")
    ).withColumn("cdc_op_type_valid", F.col("invalid_ops") == 0)
