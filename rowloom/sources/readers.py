"""Readers: CSV, JSON, JSON lines and Parquet tables, and whole dataset folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("csv", "json", "jsonl", "ndjson", "parquet")
LAYERS = ("bronze", "silver", "gold")


def scan_csv(spark: SparkSession, path: str, columns: list[str] | None = None, line_breaks: bool = True) -> DataFrame:
    """Every value is text and an empty field is empty text, not null.

    Cells may hold line breaks, so each file is read by one task; without them pass ``line_breaks=False``, and
    large files are split.
    """
    reader = spark.read.option("header", True).option("multiLine", line_breaks).option("escape", '"')
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    df = reader.csv(path)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def scan_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Files that hold one array of objects. Each file is read by one task; prefer JSON lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One object per line. A schema saves the inference pass."""
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind == "csv":
        return scan_csv(spark, path)
    if kind == "json":
        return scan_json(spark, path)
    if kind in ("jsonl", "ndjson"):
        return scan_jsonl(spark, path)
    if kind == "parquet":
        return scan_parquet(spark, path)
    raise ValueError(f"unsupported format {kind!r}")


def list_tables(spark: SparkSession, folder: str) -> dict[str, tuple[str, str]]:
    """``{table: (path, format)}`` of the files or part folders directly under a folder.

    Lists one level of the file system; part files are neither listed nor read. Empty files are no tables.
    """
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(path)
    names = [entry.getPath().getName() for entry in found if entry.isDirectory() or entry.getLen() > 0]
    tables = {}
    for name in sorted(names):
        stem, _, suffix = name.rpartition(".")
        if stem and not name.startswith((".", "_")) and suffix.lower() in FORMATS:
            tables[stem] = (f"{folder.rstrip('/')}/{name}", suffix.lower())
    return tables


def load_dataset(spark: SparkSession, folder: str, drop_empty: bool = True) -> dict[str, DataFrame]:
    """All tables of a folder. A file that can't be read raises instead of vanishing."""
    tables = {name: scan(spark, path, kind) for name, (path, kind) in list_tables(spark, folder).items()}
    if drop_empty:
        tables = {name: df for name, df in tables.items() if not df.isEmpty()}
    return tables


def load_layered(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables of a folder, else of its bronze, silver and gold folders; the first found wins."""
    found: dict[str, tuple[str, str]] = {}
    for name, (path, kind) in list_tables(spark, folder).items():
        if name not in LAYERS:
            found.setdefault(name, (path, kind))
    for layer in LAYERS:
        try:
            inner = list_tables(spark, f"{folder.rstrip('/')}/{layer}")
        except Exception as error:  # the layer folder may not exist
            if "FileNotFoundException" not in str(error):
                raise
            continue
        for name, place in inner.items():
            found.setdefault(name, place)
    return {name: scan(spark, path, kind) for name, (path, kind) in found.items()}
