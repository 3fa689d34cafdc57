"""Writers. Every task writes its own part file."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.text import as_text, number_text
from rowloom.operators.layers import gold_normalize, keep_first, silver_clean
from rowloom.sources.readers import scan

BATCH_ROWS = 1_000
CSV_FILE_ROWS = 500_000

# Nulls are written out and times keep their microseconds.
JSON_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}


def write_csv(df: DataFrame, path: str) -> str:
    """Cells are written as they are, with blanks and line breaks. Files stay small enough to be read whole."""
    text = df.select(*[as_text(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
    whole = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    text.write.mode("errorifexists").options(**whole, maxRecordsPerFile=CSV_FILE_ROWS).csv(path)
    return path


def write_jsonl(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").options(**JSON_OPTIONS).json(path)
    return path


def write_json_array(df: DataFrame, path: str) -> str:
    """One JSON array per part file: a bracketed list of the rows of each batch.

    Rows are grouped into arrays inside each partition, so no task gathers the table.
    """
    fields = F.to_json(F.struct(*df.columns), JSON_OPTIONS)

    def bracket(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        started = False
        for batch in batches:
            if not batch.num_rows:
                continue
            text = pc.binary_join_element_wise(pa.scalar(","), batch.column(0), pa.scalar(""))
            if not started:
                # The first row of the file opens the array instead.
                text = pa.concat_arrays([pc.utf8_replace_slice(text[:1], 0, 1, "["), text[1:]])
            started = True
            yield pa.RecordBatch.from_arrays([text], ["value"])
        if started:
            yield pa.RecordBatch.from_pydict({"value": pa.array(["]"], pa.string())})

    df.select(fields.alias("value")).mapInArrow(bracket, "value string").write.mode("errorifexists").text(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def sql_literal(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        text = F.when(value, "TRUE").otherwise("FALSE")
    elif isinstance(dtype, T.NumericType):
        text = number_text(value, dtype)
    else:
        raw = as_text(value, dtype)
        text = F.concat(
            F.lit("'"), F.replace(F.replace(raw, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'")
        )
    return F.when(value.isNull(), "NULL").otherwise(text)


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """One INSERT statement per row, in column ``value``."""
    head = f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("
    values = F.concat_ws(", ", *[sql_literal(F.col(f.name), f.dataType) for f in df.schema.fields])
    return df.select(F.concat(F.lit(head), values, F.lit(");")).alias("value"))


def write_sql(df: DataFrame, table: str, path: str) -> str:
    insert_statements(df, table).write.mode("errorifexists").text(path)
    return path


def write_table(df: DataFrame, path: str, kind: str, table: str = "t") -> str:
    if kind == "csv":
        return write_csv(df, path)
    if kind in ("jsonl", "ndjson"):
        return write_jsonl(df, path)
    if kind == "json":
        return write_json_array(df, path)
    if kind == "parquet":
        return write_parquet(df, path)
    if kind == "sql":
        return write_sql(df, table, path)
    raise ValueError(f"unsupported format {kind!r}")


def write_layers(df: DataFrame, folder: str, table: str, key: str, order: str, kind: str = "parquet") -> dict[str, str]:
    """Bronze, silver and gold folders; each layer is computed from the written one before it."""
    paths = {layer: f"{folder}/{layer}/{table}.{kind}" for layer in ("bronze", "silver", "gold")}
    write_table(df, paths["bronze"], kind)
    bronze = _reread(df, paths["bronze"], kind)
    write_table(keep_first(silver_clean(bronze, key), key, order), paths["silver"], kind)
    silver = _reread(df, paths["silver"], kind)
    write_table(gold_normalize(silver), paths["gold"], kind)
    return paths


def _reread(like: DataFrame, path: str, kind: str) -> DataFrame:
    """What was written, with the types of ``like``."""
    df = scan(like.sparkSession, path, kind)
    if kind == "parquet":
        return df
    return df.select(
        *[
            F.col(f.name).alias(f.name) if isinstance(f.dataType, T.StringType)
            else F.nullif(F.col(f.name).cast("string"), F.lit("")).cast(f.dataType).alias(f.name)
            for f in like.schema.fields
        ]
    )


def write_seeds(tables: Mapping[str, list[DataFrame]], folder: str) -> dict[str, str]:
    """A CSV per non-empty table; its parts may have different columns."""
    paths = {}
    for name, parts in tables.items():
        merged = parts[0]
        for part in parts[1:]:
            merged = merged.unionByName(part, allowMissingColumns=True)
        if not merged.isEmpty():
            paths[name] = write_csv(merged, f"{folder}/{name}.csv")
    return paths


def jdbc_options(url: str, table: str, properties: Mapping[str, str] | None = None) -> dict[str, str]:
    return {"url": url, "dbtable": table, "batchsize": str(BATCH_ROWS), **(properties or {})}


def write_jdbc(
    df: DataFrame, url: str, table: str, properties: Mapping[str, str] | None = None,
    column_types: str | None = None, connections: int | None = None, mode: str = "overwrite",
) -> None:
    """Batched inserts; the table is replaced by default.

    ``connections`` spreads the finished rows over that many writers, so that a database
    with few connections does not slow down the work before it.
    """
    rows = df.repartition(connections) if connections else df
    writer = rows.write.format("jdbc").mode(mode).options(**jdbc_options(url, table, properties))
    if column_types:
        writer = writer.option("createTableColumnTypes", column_types)
    writer.save()


def read_jdbc(spark: SparkSession, url: str, table: str, properties: Mapping[str, str] | None = None) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, table, properties)).load()


# Connector names of warehouses that have their own Spark data source.
WAREHOUSE_FORMATS = {"snowflake": "snowflake", "bigquery": "bigquery"}


def write_warehouse(df: DataFrame, warehouse: str, options: Mapping[str, str], mode: str = "overwrite") -> None:
    """Load through a warehouse's connector, which must be on the class path."""
    df.write.format(WAREHOUSE_FORMATS[warehouse]).mode(mode).options(**options).save()
