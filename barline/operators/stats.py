"""Overfitting-aware statistics over backtest paths."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import normal_cdf, normal_quantile
from ..schema import ANNUAL_BARS, EULER_GAMMA


#: Returns nearer to 0 count as 0: the cube of their variance leaves double range, and Spark's skewness divides by it.
LEAST_RETURN = 1e-30


def expected_max_z(n_trials: int) -> float:
    """Expected maximum of n standard normal draws, as used for deflation."""
    if n_trials < 1:
        raise ValueError("n_trials must be >= 1")
    if n_trials == 1:
        return 0.0
    return ((1 - EULER_GAMMA) * normal_quantile(1 - 1 / n_trials)
            + EULER_GAMMA * normal_quantile(1 - 1 / (n_trials * math.e)))


def deflated_sharpe(rets: DataFrame, keys: Sequence[str], n_trials: int = 50, r: str = "ret") -> DataFrame:
    """Probability that the Sharpe beats the best of ``n_trials`` skill-less ones.

    One aggregate: moments, the bias-corrected skewness and kurtosis they imply, then the normal
    CDF as a column. Under 30 returns the result is NULL; a constant series gives (0, 0).
    """
    return deflated_of(rets.where(F.col(r).isNotNull()).groupBy(*keys).agg(*moments_of(r)), keys, n_trials)


def moments_of(r: str = "ret") -> list[Column]:
    """The aggregates that ``deflated_of`` reads."""
    x = F.when(F.abs(r) < LEAST_RETURN, 0.0).otherwise(F.col(r))
    return [F.count(r).alias("n_returns"), F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"),
            F.skewness(x).alias("_g1"), F.kurtosis(x).alias("_g2")]


def deflated_of(m: DataFrame, keys: Sequence[str], n_trials: int = 50) -> DataFrame:
    """``deflated_sharpe`` of rows that hold the moments."""
    n = F.col("n_returns").cast("double")
    usable = (F.col("n_returns") >= 30) & (F.col("_s") > 0)
    g3 = F.col("_g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    g4 = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.col("_g2") + 6) + 3
    out = m.withColumns({"_sr": F.when(usable, F.col("_m") / F.nullif(F.col("_s"), F.lit(0.0))),
                         "_g3": F.when(usable, g3), "_g4": F.when(usable, g4)})
    sr = F.col("_sr")
    var = (1 - F.col("_g3") * sr + (F.col("_g4") - 1) / 4 * sr * sr) / F.nullif(n - 1, F.lit(0.0)) * ANNUAL_BARS
    sd = F.sqrt(F.greatest(var, F.lit(1e-12)))
    out = out.withColumn("_z", sr * math.sqrt(ANNUAL_BARS) / sd - F.lit(expected_max_z(n_trials)))
    constant = (F.col("n_returns") >= 30) & (F.col("_s") == 0)
    return out.select(*keys, "n_returns",
                      F.when(constant, 0.0).otherwise(normal_cdf("_z")).alias("dsr_p_value"),
                      F.when(constant, 0.0).otherwise(sr * math.sqrt(ANNUAL_BARS)).alias("dsr_sharpe"))


def overfitting_probability(perf: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Share of paths whose in-sample best strategy ranks in the lower half out of sample.

    ``perf`` has path_id, strategy_idx, is_perf, oos_perf; ties go by strategy index.
    """
    path = Window.partitionBy(*keys, "path_id")
    ranked = perf.withColumns({
        "_best": F.row_number().over(path.orderBy(F.desc("is_perf"), "strategy_idx")),
        "_rank": F.row_number().over(path.orderBy("oos_perf", "strategy_idx")),
        "_n": F.count(F.lit(1)).over(path)}).where("_best = 1")
    omega = F.col("_rank") / (F.col("_n") + 1)
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_paths"), F.avg(F.when(omega < 0.5, 1.0).otherwise(0.0)).alias("pbo"))
