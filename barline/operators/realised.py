"""Realised measures on intraday ticks.

A symbol's ticks are unbounded, so no window here is partitioned by symbol: the previous tick comes from a lag over ranges
of (symbol, ts, seq), and days are partial aggregates.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranged import lag_by_range


def intraday_returns(ticks: DataFrame) -> DataFrame:
    """Log returns over the whole tick series: a day's first return reaches back to the day before."""
    df = lag_by_range(ticks.withColumn("_lc", F.ln("close")), ["symbol"], ["ts", "seq"], {"_lp": "_lc"})
    return df.withColumn("r", F.col("_lc") - F.col("_lp")).where("r IS NOT NULL").drop("_lc", "_lp")


def daily_moments(returns: DataFrame) -> DataFrame:
    """Sums of powers of returns per symbol and day: partial aggregates, no hot group."""
    r = F.col("r")
    return returns.groupBy("symbol", F.to_date("ts").alias("day")).agg(
        F.count(r).alias("n"), F.sum(r * r).alias("rv"),
        F.sum(F.when(r > 0, r * r).otherwise(0.0)).alias("rsv_pos"),
        F.sum(F.when(r < 0, r * r).otherwise(0.0)).alias("rsv_neg"),
        F.sum(r * r * r).alias("r3"))


def on_calendar(daily: DataFrame, columns: list[str]) -> DataFrame:
    """Every calendar day between a symbol's first and last; days without ticks give zeros."""
    span = daily.groupBy("symbol").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select("symbol", F.explode(F.sequence("a", "b")).alias("day"))
    out = days.join(daily, ["symbol", "day"], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns})


def realised_variance(returns: DataFrame) -> DataFrame:
    return on_calendar(daily_moments(returns).select("symbol", "day", "rv"), ["rv"])


def realised_semivariance(returns: DataFrame) -> DataFrame:
    cols = ["rsv_pos", "rsv_neg"]
    return on_calendar(daily_moments(returns).select("symbol", "day", *cols), cols)


def realised_skewness(returns: DataFrame) -> DataFrame:
    m = daily_moments(returns)
    skew = F.sqrt(F.col("n")) * F.col("r3") / F.nullif(F.pow("rv", F.lit(1.5)), F.lit(0.0))
    return on_calendar(m.select("symbol", "day", skew.alias("rskew")), ["rskew"])


def bipower_variation(returns: DataFrame) -> DataFrame:
    """Jump-robust variance: products of neighbouring absolute returns."""
    pairs = lag_by_range(returns.withColumn("_a", F.abs("r")), ["symbol"], ["ts", "seq"], {"_p": "_a"})
    daily = pairs.groupBy("symbol", F.to_date("ts").alias("day")).agg(
        (F.lit(math.pi / 2) * F.coalesce(F.sum(F.col("_a") * F.col("_p")), F.lit(0.0))).alias("bv"))
    return on_calendar(daily, ["bv"])


def jump_component(returns: DataFrame) -> DataFrame:
    """Realised variance against bipower variation per day."""
    both = realised_variance(returns).join(bipower_variation(returns), ["symbol", "day"])
    return both.withColumn("jump", F.greatest(F.col("rv") - F.col("bv"), F.lit(0.0)))


def ohlc_bars(ticks: DataFrame, width: str = "1 day") -> DataFrame:
    """Bars of fixed width from ticks; one partial aggregate."""
    at = F.struct("ts", "seq")
    return ticks.groupBy("symbol", F.window("ts", width)["start"].alias("ts")).agg(
        F.min_by("close", at).alias("open"), F.max("close").alias("high"),
        F.min("close").alias("low"), F.max_by("close", at).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"))
