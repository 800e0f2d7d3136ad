"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, path: str | None = None) -> str:
    """A fresh folder below ``path`` or ``spark.checkpoint.dir``; only a session on one machine may do without both."""
    root = path or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/barline-{uuid.uuid4().hex}"
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("name a shared folder: pass a path or set spark.checkpoint.dir")
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def stored(df: DataFrame) -> DataFrame:
    """The frame written once and read back: later users scan a small table instead of repeating its plan."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
