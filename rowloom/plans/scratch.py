"""Where intermediate results go: the folder the session names, shared by all executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The session's checkpoint folder, which every executor must see.

    Only on a local master, where all of Spark is one process, a temporary folder is made where none is set.
    What is written below it belongs to the caller's job and can be removed once its results are written.
    """
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="rowloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the scratch folder."""
    return f"{scratch_root(spark)}/rowloom/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage and fix partition contents with a reliable checkpoint."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)
