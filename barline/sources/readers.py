"""Reading, validating and slicing source tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ColumnOrName, col, finite_or_null
from ..functions.frame import tail_rows
from ..schema import EMAIL_PATTERN, HISTORY_BARS, TICKER_PATTERN


def scan_close(df: DataFrame, symbols: Sequence[str] | None, start: str, end: str, symbol: str = "symbol",
               ts: str = "ts", value: str = "close") -> DataFrame:
    """One value column for [start, end). Filters sit on raw columns, so they reach the scan."""
    out = df
    if symbols is not None:
        out = out.where(F.col(symbol).isin(list(symbols)))
    kind = df.schema[ts].dataType
    lo, hi = F.lit(start).cast(kind), F.lit(end).cast(kind)
    out = out.where((F.col(ts) >= lo) & (F.col(ts) < hi))
    return out.select(F.col(symbol).alias("symbol"), F.col(ts).alias("ts"),
                      F.col(value).cast("double").alias("close")).na.drop(subset=["close"])


def read_closes(spark: SparkSession, root: str, symbols: Sequence[str] | None, start: str, end: str) -> DataFrame:
    """Close series from a cache laid out by ``sinks.write_cache`` (partitioned by symbol)."""
    return scan_close(spark.read.parquet(root), symbols, start, end)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Landed macro files: one JSON object per file with an ``observations`` array."""
    obs = T.ArrayType(T.StructType([T.StructField("date", T.DateType()), T.StructField("value", T.StringType())]))
    doc = T.StructType([T.StructField("series_id", T.StringType()), T.StructField("observations", obs)])
    rows = spark.read.schema(doc).json(path, multiLine=True).select("series_id", F.explode("observations").alias("o"))
    return rows.select("series_id", "o.date", finite_or_null("o.value").alias("value")).na.drop(subset=["value"])


def parse_observations(df: DataFrame, json_column: str, path: str) -> DataFrame:
    """Numeric observation inside a JSON column; ".", "" and null are missing and dropped."""
    value = finite_or_null(F.get_json_object(json_column, path))
    return df.withColumn("value", value).na.drop(subset=["value"])


def last_ticks(ticks: DataFrame, n: int) -> DataFrame:
    """Last n ticks per symbol.

    Each (symbol, hour) keeps its own last n first, so no task ranks a whole hot symbol; the
    second ranking sees at most n rows per bucket.
    """
    newest = [F.desc("ts"), F.desc("seq")]
    ticks = ticks.withColumn("_b", F.floor(F.unix_seconds("ts") / 3600))
    near = Window.partitionBy("symbol", "_b").orderBy(*newest)
    kept = ticks.withColumn("_rn", F.row_number().over(near)).where(F.col("_rn") <= n)
    # buckets that can still matter: fewer than n ticks lie in newer buckets of the symbol
    sizes = kept.groupBy("symbol", "_b").agg(F.count(F.lit(1)).alias("_n"))
    newer = F.sum("_n").over(Window.partitionBy("symbol").orderBy(F.desc("_b")).rowsBetween(
        Window.unboundedPreceding, -1))
    live = sizes.withColumn("_newer", F.coalesce(newer, F.lit(0))).where(F.col("_newer") < n)
    out = kept.join(live.select("symbol", "_b", "_newer"), ["symbol", "_b"])
    return out.where(F.col("_newer") + F.col("_rn") <= n).drop("_rn", "_b", "_newer")


def asset_dim(universe: DataFrame, markets: DataFrame, key: str, market_key: str) -> DataFrame:
    """Universe with display name (falling back to the symbol) and market attributes."""
    joined = universe.join(markets, F.col(key) == F.col(market_key), "left")
    return joined.withColumn("name", F.coalesce("display_name", "symbol"))


def coverage_gate(universe: DataFrame, ready: DataFrame, share: float = 0.7) -> DataFrame:
    """One row: whether enough of the universe has results for the snapshot to be published."""
    hit = ready.select("symbol").distinct().withColumn("_ok", F.lit(1))
    counts = universe.join(hit, "symbol", "left").agg(
        F.count(F.lit(1)).alias("n_expected"), F.count("_ok").alias("n_ready"))
    out = counts.withColumn("n_required", F.greatest(
        F.lit(1), F.floor(F.col("n_expected") * share)).cast("bigint"))
    return out.withColumn("publish", F.col("n_ready") >= F.col("n_required"))


def valid_symbol(c: ColumnOrName) -> Column:
    return col(c).rlike(TICKER_PATTERN)


def valid_email(c: ColumnOrName) -> Column:
    return col(c).rlike(EMAIL_PATTERN)


def history_slice(bars: DataFrame, days: int = 252) -> DataFrame:
    """Last ``days`` bars per symbol, at least 1 and at most two years."""
    if days < 1:
        raise ValueError("days must be >= 1")
    return tail_rows(bars, min(days, HISTORY_BARS), "ts")


def trailing_return(bars: DataFrame, n: int = 22) -> DataFrame:
    """Simple return between the first and last of the last n bars."""
    return tail_rows(bars, n).groupBy("symbol").agg(
        (F.max_by("close", "pos") / F.nullif(F.min_by("close", "pos"), F.lit(0.0)) - 1).alias(f"ret_{n}"))


def search_universe(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Case-insensitive substring on any of the columns."""
    needle = F.lit(text.lower())
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c)), needle)
    return df.where(hit)


def with_freshness(df: DataFrame, now: DataFrame, ts: str) -> DataFrame:
    """Age class against a one-row ``now`` table: under 6 h fresh, under 24 h dated, else stale."""
    hours = (F.unix_micros("now") - F.unix_micros(F.col(ts).cast("timestamp"))) / 3_600_000_000
    aged = df.withColumn("_one", F.lit(1)).join(
        F.broadcast(now.select(F.col("now").cast("timestamp").alias("now"), F.lit(1).alias("_one"))), "_one")
    return aged.withColumn("freshness", F.when(hours < 6, "fresh").when(hours < 24, "dated").otherwise("stale"))


def universe_kpis(df: DataFrame, sharpe: str = "sharpe") -> DataFrame:
    s = F.coalesce(F.col(sharpe), F.lit(0.0))
    return df.agg(F.count(F.lit(1)).alias("n_assets"), F.count_if(s > 0).alias("n_positive"),
                  F.avg(s).alias("mean_sharpe"))
