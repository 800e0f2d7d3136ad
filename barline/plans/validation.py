"""Cross-validated backtests of many strategies on many series as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..functions.store import stored
from ..operators import backtest as bt
from ..operators.folds import cpcv_split
from ..operators.stats import deflated_of, deflated_sharpe, moments_of, overfitting_probability

KEYS = ["strategy", "symbol"]


def backtest_cells(frame: DataFrame, strategies: Mapping[str, Column], in_sample: bool = False,
                   risk: bool = False, cost: Column | None = None, n_splits: int = 10, n_test: int = 2,
                   embargo_pct: float = 0.01, spread: bool = True) -> DataFrame:
    """Net returns per (strategy, symbol, path, role, pos).

    ``frame`` has symbol, pos, r, horizon and whatever the strategy expressions read; strategies
    that need state arrive as precomputed columns. Without in-sample rows and risk limits each bar
    expands only into the paths that test it.
    """
    split = cpcv_split(frame, n_splits, n_test, embargo_pct, test_only=not (in_sample or risk), spread=spread)
    keep = [*bt.PATH, "pos", "r", *(["volume"] if "volume" in frame.columns else [])]
    if risk:
        split = bt.risk_limits(split)
        keep += ["var_limit", "halted"]
    split = split.where("role IN ('train', 'test')" if in_sample else "role = 'test'")
    cells = bt.fan_out(split, strategies, keep)
    if risk:
        cells = cells.withColumn("position", bt.limited_position())
    return bt.strategy_returns(cells, cost)


def with_deflated(report: DataFrame, cells: DataFrame, metrics: DataFrame, n_trials: int) -> DataFrame:
    """Deflated Sharpe of the median path, joined to the per-strategy report."""
    median = bt.median_path(metrics).select(*KEYS, "path_id")
    rets = cells.where("role = 'test'").join(median, [*KEYS, "path_id"], "left_semi")
    return report.join(deflated_sharpe(rets, KEYS, n_trials).drop("n_returns"), KEYS, "left")


def validate(frame: DataFrame, strategy: str, position: Column, n_trials: int = 50, **options) -> DataFrame:
    """One strategy on every series: one report row per symbol."""
    cells = backtest_cells(frame, {strategy: position}, **options)
    metrics = bt.path_metrics(cells.where("role = 'test'"))
    return with_deflated(bt.path_distribution(metrics), cells, metrics, n_trials)


def performance_matrix(cells: DataFrame) -> DataFrame:
    """In-sample and out-of-sample Sharpe per (symbol, path, strategy) in one aggregate."""
    both = cells.groupBy("symbol", "path_id", "strategy", "strategy_idx").pivot("role", ["train", "test"]).agg(
        bt.sharpe_of())
    return both.withColumnsRenamed({"train": "is_perf", "test": "oos_perf"})


def validate_many(frame: DataFrame, strategies: Mapping[str, Column], n_trials: int = 50, **options) -> DataFrame:
    """All strategies on shared folds, with the overfitting probability of the population."""
    cells = backtest_cells(frame, strategies, in_sample=True, **options)
    return report_of(cells, len(strategies), n_trials)


Strategy = Callable[[DataFrame], DataFrame]
"""Fold view (symbol, path_id, role train or test, pos, ts, r and features) to positions (symbol, path_id, role, pos, position).

A strategy may fit on each path's train rows; it returns positions for both roles.
"""

CELL = ["symbol", "path_id", "role", "pos"]
FITS_AT_ONCE = 3


def row_strategy(position: Column) -> Strategy:
    """A strategy without state: one expression per row."""
    return lambda view: view.select(*CELL, position.cast("double").alias("position"))


def panel_cells(frame: DataFrame, strategies: Mapping[str, Strategy], cost: Column | None = None, risk: bool = True,
                **folds) -> DataFrame:
    """Net returns per (strategy, symbol, path, role, pos) of strategies that see the folds, after limits and costs.

    The fold view is written once; every strategy and the limits read that table. Strategies that fit run their jobs side by
    side, ``FITS_AT_ONCE`` at a time: one's rounds are many short jobs that leave cores idle.
    """
    view = cpcv_split(frame, **folds)
    view = stored(bt.risk_limits(view) if risk else view.where("role IN ('train', 'test')"))
    inputs = view.drop("var_limit", "halted", "test_groups")
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        fits = [pool.submit(inheritable_thread_target(view.sparkSession)(fn), inputs) for fn in strategies.values()]
        found = [fit.result() for fit in fits]
    parts = [p.select(*CELL, "position", F.lit(n).alias("strategy"), F.lit(i).alias("strategy_idx"))
             for i, (n, p) in enumerate(zip(strategies, found))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    extra = [c for c in ("r", "var_limit", "halted", "volume") if c in view.columns]
    cells = rows.join(view.select(*CELL, *extra), CELL)
    if risk:
        cells = cells.withColumn("position", bt.limited_position())
    return stored(bt.strategy_returns(cells, cost))


def validate_panel(frame: DataFrame, strategies: Mapping[str, Strategy], n_trials: int = 50, **options) -> DataFrame:
    """The report of ``validate_many`` for strategies that see the folds."""
    return report_of(panel_cells(frame, strategies, **options), len(strategies), n_trials)


def report_of(cells: DataFrame, n_strategies: int, n_trials: int) -> DataFrame:
    """Path distribution, deflated Sharpe and overfitting probability of net returns."""
    metrics = bt.path_metrics(cells.where("role = 'test'"))
    report = with_deflated(bt.path_distribution(metrics), cells, metrics, n_trials)
    if n_strategies < 2:
        return report.withColumn("pbo", F.lit(None).cast("double"))
    pbo = overfitting_probability(performance_matrix(cells)).select("symbol", "pbo")
    return report.join(pbo, "symbol", "left")


def evaluate_assets(frame: DataFrame, strategy: str, position: Column, min_bars_per_split: int = 50,
                    n_splits: int = 10, n_trials: int = 50, **options) -> DataFrame:
    """``validate`` for a universe: series too short to split get an error row, not a failure.

    The frame is written once with the few columns that folds and the strategy read. A series' paths stay in its task, and
    metrics and return moments come from one pass over them: no expanded row is shuffled, whatever the number of paths.
    """
    frame = stored(frame)
    counts = frame.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    need = min_bars_per_split * n_splits
    long = frame.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).where(F.col("_n") >= need).drop("_n")
    cells = backtest_cells(long, {strategy: position}, n_splits=n_splits, spread=False, **options)
    metrics = stored(bt.path_metrics(cells.where("role = 'test'"), more=moments_of()))
    median = bt.median_path(metrics).select(*KEYS, "more.*")
    report = bt.path_distribution(metrics).join(deflated_of(median, KEYS, n_trials).drop("n_returns"), KEYS, "left")
    error = F.when(F.col("n_bars") < need, F.format_string(
        f"only %d bars, need at least {need}", F.col("n_bars")))
    return counts.withColumn("error", error).join(report.drop("strategy"), "symbol", "left")


def robustness_summary(evaluated: DataFrame, gate: float = 0.70) -> DataFrame:
    """Universe-level pass rate of ``evaluate_assets``."""
    ok = F.col("error").isNull() & F.col("sharpe_p50").isNotNull()
    s = F.when(ok, F.col("sharpe_p50"))
    out = evaluated.agg(
        F.count(F.lit(1)).alias("n_assets"), F.count(s).alias("n_evaluated"),
        F.count_if(s > 0).alias("n_positive"), F.avg(s).alias("mean_sharpe"), F.median(s).alias("median_sharpe"))
    share = F.when(F.col("n_evaluated") > 0, F.col("n_positive") / F.nullif(F.col("n_evaluated"), F.lit(0))).otherwise(0.0)
    return out.withColumns({"n_failed": F.col("n_assets") - F.col("n_evaluated"), "fraction_positive": share}).withColumn(
        "passes_gate", F.coalesce((F.col("fraction_positive") >= gate) & (F.col("mean_sharpe") > 0), F.lit(False)))


def lookahead_check(frame: DataFrame, operator: Callable[[DataFrame], DataFrame], outputs: str | list[str],
                    inputs: list[str], n_samples: int = 10, tolerance: float = 1e-9) -> DataFrame:
    """Do ``operator``'s outputs at bar t move when bars after t are perturbed? A row per symbol and output.

    ``n_samples`` probe bars per series come from the middle 80 %, by hash. Each probe is a copy of
    its series under its own symbol with later rows scaled by a hash-seeded factor in [0.5, 2], so
    the operator runs once, over all probes in parallel. Bars are matched by ``ts``: operators may
    drop warm-up bars and number the rest anew. A bar the operator drops on both sides counts as unmoved.
    """
    outputs = [outputs] if isinstance(outputs, str) else outputs
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    edge = F.greatest(F.floor(n * 0.1), F.lit(1))
    pick = F.row_number().over(Window.partitionBy("symbol").orderBy(F.xxhash64("symbol", "pos")))
    middle = frame.withColumns({"_edge": edge, "_n": n}).where(
        (F.col("pos") >= F.col("_edge")) & (F.col("pos") < F.col("_n") - F.col("_edge")))
    probes = middle.select("symbol", F.col("pos").alias("probe"), F.col("ts").alias("probe_ts"), pick.alias("_rn")).where(
        F.col("_rn") <= n_samples).drop("_rn")
    factor = F.lit(0.5) + F.pmod(F.xxhash64("symbol", "probe", "pos"), F.lit(1_000_003)) / 1_000_003.0 * 1.5
    copies = frame.join(probes, "symbol").withColumns({
        c: F.when(F.col("pos") > F.col("probe"), F.col(c) * factor).otherwise(F.col(c)) for c in inputs})
    copies = copies.withColumn("symbol", F.concat("symbol", F.lit("#"), F.col("probe").cast("string"))).drop("probe", "probe_ts")

    def melted(df: DataFrame, value: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("output"), F.col(c).cast("double").alias(value)) for c in outputs])
        return df.select("symbol", "probe", F.inline(cells))

    moved = operator(copies).withColumns({"probe": F.substring_index("symbol", "#", -1).cast("int"),
                                          "symbol": F.regexp_replace("symbol", "#[0-9]+$", "")})
    moved = melted(moved.join(probes, ["symbol", "probe"]).where("ts = probe_ts"), "_p")
    base = operator(frame).join(probes.withColumnRenamed("probe_ts", "ts"), ["symbol", "ts"])
    every = probes.select("symbol", "probe", F.explode(F.array(*map(F.lit, outputs))).alias("output"))
    keys = ["symbol", "probe", "output"]
    both = every.join(melted(base, "_b"), keys, "left").join(moved, keys, "left")
    delta = F.abs(F.coalesce("_p", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))
    flips = F.col("_p").isNull() != F.col("_b").isNull()
    out = both.groupBy("symbol", "output").agg(
        F.count(F.lit(1)).alias("n_samples"), F.count("_b").alias("n_compared"), F.max(delta).alias("max_delta"),
        F.count_if(flips | (delta > tolerance + 1e-6 * F.abs(F.coalesce("_b", F.lit(0.0))))).alias("n_violations"))
    return out.withColumn("passed", F.col("n_violations") == 0)
