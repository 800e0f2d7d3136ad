"""Backtest arithmetic on (strategy, symbol, path_id, role, pos) rows.

Risk limits depend on the asset's returns only, so they are computed once per (symbol, path, role)
and strategies are fanned out afterwards as a generator. Everything downstream shares one key.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ColumnOrName, col
from ..functions.frame import UNB, series, tail_rows
from ..schema import ANNUAL_BARS, ASSET_COST_BPS, COST_BPS_DEFAULT, HISTORY_BARS, ILLIQUIDITY_CLIP

PATH = ["symbol", "path_id", "role"]
CELL = ["strategy", *PATH]


def benchmark_positions() -> dict[str, Column]:
    """Row-local reference strategies."""
    return {"buy_hold": F.lit(1.0), "flat": F.lit(0.0),
            "momentum_20d": F.when(F.col("mom_20") > 0, 1.0).otherwise(0.0)}


def fan_out(df: DataFrame, strategies: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """One row per input row and strategy, with its index in registration order."""
    cells = F.array(*[F.struct(F.lit(n).alias("strategy"), F.lit(i).alias("strategy_idx"),
                               e.cast("double").alias("position"))
                      for i, (n, e) in enumerate(strategies.items())])
    return df.select(*keep, F.inline(cells))


def gross_return(position: ColumnOrName = "position", r: ColumnOrName = "r") -> Column:
    return col(position) * col(r)


def turnover(keys: Sequence[str] = CELL) -> Column:
    """Absolute position change; the first bar opens from flat, gaps between test blocks count."""
    w = Window.partitionBy(*keys).orderBy("pos")
    return F.abs(F.col("position") - F.lag("position", 1, 0.0).over(w))


def flat_cost(bps: float = COST_BPS_DEFAULT, keys: Sequence[str] = CELL) -> Column:
    return F.lit(bps / 1e4) * turnover(keys)


def illiquidity_cost(keys: Sequence[str] = CELL, volume: str = "volume") -> Column:
    """Per-symbol base cost scaled by clipped median volume over the bar's volume."""
    known = F.create_map(*[F.lit(x) for kv in ASSET_COST_BPS.items() for x in kv])
    base = F.coalesce(F.try_element_at(known, F.col("symbol")), F.lit(COST_BPS_DEFAULT))
    valid = F.when(F.col(volume) > 0, F.col(volume))
    typical = F.percentile(valid, F.lit(0.5)).over(Window.partitionBy(*keys))
    lo, hi = ILLIQUIDITY_CLIP
    ratio = F.coalesce(typical / valid, F.lit(1.0))
    scale = F.when(typical.isNull(), F.lit(1.0)).otherwise(
        F.least(F.greatest(ratio, F.lit(lo)), F.lit(hi)))
    return base * scale / F.lit(1e4) * turnover(keys)


def risk_limits(split: DataFrame, var_conf: float = 0.95, var_window: int = 60, nav_pct: float = 0.02,
                dd_limit: float = 0.15, dd_reentry: float = 0.075, seed: bool = True) -> DataFrame:
    """Adds var_limit (largest allowed position, NULL for none) and halted per role row.

    The test role's value-at-risk window starts filled with the tail of the path's train returns;
    the train role starts cold. The drawdown breaker follows the asset, so its state is a running
    product, a running maximum and the last threshold crossed: windows, no recursion.
    """
    live = split.where("role IN ('train', 'test')").withColumn("_seed", F.lit(0))
    rows = live
    if seed:
        newest = Window.partitionBy("symbol", "path_id").orderBy(F.desc("pos"))
        tail = (split.where("role = 'train'").withColumn("_rn", F.row_number().over(newest))
                .where(F.col("_rn") <= var_window).drop("_rn")
                .withColumn("role", F.lit("test")).withColumn("_seed", F.lit(1)))
        rows = live.unionByName(tail)
    w = Window.partitionBy(*PATH).orderBy(F.desc("_seed"), "pos")
    recent = w.rowsBetween(-var_window, -1)
    before = w.rowsBetween(UNB, -1)
    q = F.percentile("r", F.lit(1 - var_conf)).over(recent)
    growth = F.when(F.col("_seed") == 0, 1 + F.col("r")).otherwise(1.0)
    out = rows.withColumns({
        "_q": F.when(F.count("r").over(recent) >= 5, q),
        "_equity": F.coalesce(F.product(growth).over(before), F.lit(1.0))})
    dd = F.col("_equity") / F.max("_equity").over(w.rowsBetween(UNB, 0)) - 1
    crossed = F.when(dd < -dd_limit, True).when(dd > -dd_reentry, False)
    out = out.withColumn("_crossed", crossed)
    out = out.withColumns({
        "var_limit": F.when(F.col("_q") < 0, F.lit(nav_pct) / F.abs("_q")),
        "halted": F.coalesce(F.last("_crossed", ignorenulls=True).over(w.rowsBetween(UNB, 0)), F.lit(False))})
    return out.where("_seed = 0").drop("_seed", "_q", "_equity", "_crossed")


def limited_position(position: ColumnOrName = "position") -> Column:
    """Position after the value-at-risk gate, then the breaker."""
    p = col(position)
    size = F.when(F.col("var_limit").isNotNull(), F.least(F.abs(p), F.col("var_limit"))).otherwise(F.abs(p))
    return F.when(F.col("halted"), 0.0).otherwise(F.signum(p) * size)


def strategy_returns(cells: DataFrame, cost: Column | None = None) -> DataFrame:
    """Net return per bar: position x return minus cost."""
    return cells.withColumn("_cost", flat_cost() if cost is None else cost).withColumn(
        "ret", gross_return() - F.col("_cost")).withColumnRenamed("_cost", "cost")


def sharpe_of(r: str = "ret") -> Column:
    """Annualised Sharpe as an aggregate; 0 for a constant series, NULL under two values."""
    sd = F.stddev_samp(r)
    return F.when(F.count(r) < 2, None).when(sd > 0, F.avg(r) / F.nullif(sd, F.lit(0.0)) * math.sqrt(ANNUAL_BARS)).otherwise(0.0)


def annualised_sharpe(df: DataFrame, keys: Sequence[str], r: str = "ret") -> DataFrame:
    return df.groupBy(*keys).agg(sharpe_of(r).alias("sharpe"))


def path_metrics(rets: DataFrame, keys: Sequence[str] = ("strategy", "symbol", "path_id"),
                 extra: Sequence[str] = (), more: Sequence[Column] = ()) -> DataFrame:
    """n_bars, total return, Sharpe, Sortino, max drawdown, Calmar per path, and the aliased aggregates ``more`` as struct ``more``."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(UNB, 0)
    eq = (rets.where("ret IS NOT NULL").withColumn("_eq", F.exp(F.sum("ret").over(w)))
          .withColumn("_dd", F.col("_eq") / F.max("_eq").over(w) - 1))
    neg = F.when(F.col("ret") < 0, F.col("ret"))
    agg = eq.groupBy(*keys, *extra).agg(
        F.count("ret").alias("n_bars"), F.sum("ret").alias("_total"), F.avg("ret").alias("_mean"),
        sharpe_of().alias("sharpe"), F.min("_dd").alias("_mdd"),
        F.when(F.count(neg) > 1, F.stddev_samp(neg)).alias("_down"), *([F.struct(*more).alias("more")] if more else []))
    few = F.col("n_bars") < 2
    mean, down, mdd = F.col("_mean"), F.col("_down"), F.col("_mdd")
    edge = F.when(mean > 0, float("inf")).otherwise(0.0)
    sortino = F.when(down > 0, mean / F.nullif(down, F.lit(0.0)) * math.sqrt(ANNUAL_BARS)).otherwise(edge)
    calmar = F.when(mdd < 0, mean * ANNUAL_BARS / F.nullif(F.abs(mdd), F.lit(0.0))).otherwise(edge)
    return agg.select(*keys, *extra, "n_bars", F.when(few, 0.0).otherwise(F.col("_total")).alias("total_return"),
                      "sharpe", F.when(~few, sortino).alias("sortino"),
                      F.when(~few, mdd).alias("max_drawdown"), F.when(~few, calmar).alias("calmar"), *(["more"] if more else []))


def path_distribution(metrics: DataFrame, keys: Sequence[str] = ("strategy", "symbol")) -> DataFrame:
    """Percentiles over paths: one row per strategy and symbol."""
    pct = F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))
    agg = metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_paths"), F.percentile("sharpe", pct).alias("_s"),
        F.avg("sharpe").alias("sharpe_mean"), F.stddev_samp("sharpe").alias("sharpe_std"),
        F.percentile("max_drawdown", pct).alias("_d"))
    cols = [F.col(f"_{a}")[i].alias(f"{n}_{p}") for a, n in (("s", "sharpe"), ("d", "max_dd"))
            for i, p in enumerate(("p05", "p50", "p95"))]
    return agg.select(*keys, "n_paths", *cols, "sharpe_mean", "sharpe_std")


def median_path(metrics: DataFrame, keys: Sequence[str] = ("strategy", "symbol")) -> DataFrame:
    """The path at index n // 2 in ascending (sharpe, path_id) order."""
    ok = metrics.where("sharpe IS NOT NULL")
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy("sharpe", "path_id"))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return ok.withColumns({"_rn": rn, "_n": n}).where(F.col("_rn") == F.floor(F.col("_n") / 2) + 1).drop("_rn", "_n")


def equity_curves(df: DataFrame, positions: Mapping[str, str], tail: int = HISTORY_BARS) -> DataFrame:
    """exp of cumulative lagged-position returns per strategy and buy-and-hold, rebased on the tail."""
    w = series()
    r = F.coalesce("r", F.lit(0.0))
    legs = {n: F.coalesce(F.lag(p).over(w), F.lit(0.0)) * r for n, p in positions.items()}
    legs["bh"] = r
    out = df.withColumns({f"_{n}": e for n, e in legs.items()})
    out = out.withColumns({f"eq_{n}": F.exp(F.sum(f"_{n}").over(w.rowsBetween(UNB, 0))) for n in legs})
    out = tail_rows(out.drop(*[f"_{n}" for n in legs]), tail)
    first = w.rowsBetween(UNB, Window.unboundedFollowing)
    return out.withColumns({f"eq_{n}": F.col(f"eq_{n}") / F.first(f"eq_{n}").over(first) for n in legs})


def forecast_rmse(df: DataFrame, forecast: str, window: int = 21, min_rows: int = 30) -> DataFrame:
    """Forecast against a rolling benchmark as predictors of the next bar's absolute return."""
    w = series()
    frame = w.rowsBetween(-(window - 1), 0)
    base = df.withColumn("_v", F.when(F.count("r").over(frame) >= window, F.stddev_samp("r").over(frame)))
    rows = base.withColumns({"_target": F.abs(F.lead("r").over(w)), "_bench": F.lag("_v").over(w)})
    upto = w.rowsBetween(UNB, 0)
    rows = rows.withColumns({"_model": F.last(forecast, ignorenulls=True).over(upto),
                             "_bench": F.last("_bench", ignorenulls=True).over(upto)})
    ok = rows.na.drop(subset=["_target", "_model", "_bench"])
    agg = ok.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(F.pow(F.col("_target") - F.col("_model"), 2))).alias("_m"),
        F.sqrt(F.avg(F.pow(F.col("_target") - F.col("_bench"), 2))).alias("_b"))
    enough = F.col("n") >= min_rows
    return agg.select("symbol", "n", F.when(enough, F.col("_m")).alias("model_rmse"),
                      F.when(enough, F.col("_b")).alias("rolling_rmse"),
                      F.coalesce(enough & (F.col("_m") < F.col("_b")), F.lit(False)).alias("passes_gate"))


def select_winner(report: DataFrame, preferred: Sequence[str], band: float = 0.10,
                  score: str = "sharpe_p50") -> DataFrame:
    """Best score per symbol; among several within ``band`` of it, the best preferred strategy."""
    whole = Window.partitionBy("symbol")
    close = report.where(F.col(score).isNotNull()).withColumn("_top", F.max(score).over(whole)).where(
        F.col("_top") - F.col(score) <= band)
    tied = F.count(F.lit(1)).over(whole)
    pref = F.when((tied > 1) & F.col("strategy").isin(list(preferred)), 0).otherwise(1)
    order = whole.orderBy("_pref", F.desc(score), "strategy")
    return (close.withColumns({"n_tied": tied, "_pref": pref}).withColumn("_rn", F.row_number().over(order))
            .where("_rn = 1").select("symbol", "strategy", score, "n_tied"))
