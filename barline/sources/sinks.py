"""Writers: payloads, cache, snapshots and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import safe_symbol


def write_payloads(payloads: DataFrame, path: str) -> None:
    """Compact JSON, one directory per symbol, so one asset is one pruned read and a refresh replaces it alone."""
    (payloads.withColumn("safe", safe_symbol("symbol")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("symbol").json(path))


def read_payloads(spark: SparkSession, path: str, schema: str, symbol: str | None = None) -> DataFrame:
    """Payloads back with the writer's schema; one symbol reads one directory."""
    df = spark.read.schema(schema).json(path)
    return df if symbol is None else df.where(F.col("symbol") == symbol)


def write_cache(bars: DataFrame, path: str) -> None:
    """Close cache by symbol; rewriting some symbols leaves the others in place."""
    (bars.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(path))


def append_snapshot(summary: DataFrame, path: str) -> None:
    """Snapshots accumulate by generated_at; the previous one is a rank, not a copied file."""
    summary.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generated_at").parquet(path)


ASSET = "symbol string, name string, as_of date, close double, label int, regime string, risk_level string"


def write_snapshot_json(summary: DataFrame, path: str) -> None:
    """One JSON document per snapshot: generated_at and the array of its assets (see ``snapshot.snapshot_summary``)."""
    assets = F.sort_array(F.collect_list(F.struct(*[c for c in summary.columns if c != "generated_at"])))
    (summary.groupBy("generated_at").agg(assets.alias("assets")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("generated_at").json(path))


def read_snapshot_json(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot documents as flat rows, one per asset; a snapshot without assets gives none."""
    docs = spark.read.schema(f"assets array<struct<{ASSET.replace(' ', ':').replace(',:', ',')}>>, generated_at date").json(path)
    return docs.select("generated_at", F.inline("assets"))

