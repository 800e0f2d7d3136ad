"""Folds, backtests and their statistics."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import clip
from ..functions.store import stored
from ..models.classifier import ridge_blend
from ..models.volatility import vol_target_position
from ..operators import backtest as bt
from ..operators import features as feat
from ..operators import folds, stats
from ..operators import regimes as rg
from ..plans import strategies
from ..plans import validation as val
from ..sources import testdata as td
from .base import query
from .core import tb
from .sql import CTES, W, cte, roll
from ..operators import labels

P = "PARTITION BY strategy, symbol, path_id, role"

cte("folds", "", """
SELECT row_number() OVER (ORDER BY a.range, b.range) - 1 AS path_id, a.range AS g1, b.range AS g2
FROM range(10) a JOIN range(10) b ON a.range < b.range""")
cte("frame", "tb bars_f1", """
SELECT t.symbol, t.pos, t.ts, t.close, t.r, t.horizon, f.mom_20, f.vol_ewma, count(*) OVER (PARTITION BY t.symbol) AS n_bars,
 count(*) OVER (PARTITION BY t.symbol) // 10 AS group_size,
 least(t.pos // (count(*) OVER (PARTITION BY t.symbol) // 10), 9) AS group_id
FROM tb t JOIN bars_f1 f ON t.symbol = f.symbol AND t.pos = f.pos""")


def _end(g: str) -> str:
    return f"(CASE WHEN {g} = 9 THEN n_bars - 1 ELSE ({g} + 1) * group_size - 1 END)"


_span = "least(pos + greatest(horizon, 0), n_bars - 1)"
_purge = " OR ".join(f"(pos <= {_end(g)} AND {_span} >= {g} * group_size)" for g in ("g1", "g2"))
_emb = " OR ".join(f"(pos > {_end(g)} AND pos <= {_end(g)} + ceil(0.01 * n_bars))" for g in ("g1", "g2"))
_fix = " OR ".join(f"(pos >= {g} * group_size - 10 AND pos < {g} * group_size)" for g in ("g1", "g2"))
cte("split", "frame folds", f"""
SELECT frame.*, path_id, g1, g2, CASE WHEN group_id IN (g1, g2) THEN 'test'
 WHEN {_purge} OR {_emb} THEN 'dropped' ELSE 'train' END AS role FROM frame CROSS JOIN folds""")
cte("cells", "split", """
SELECT s.symbol, s.path_id, s.role, s.pos, s.ts, s.r, x.strategy, x.idx AS strategy_idx,
 CASE x.idx WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE CASE WHEN s.mom_20 > 0 THEN 1.0 ELSE 0.0 END END AS position
FROM split s CROSS JOIN (VALUES ('buy_hold', 0), ('flat', 1), ('momentum_20d', 2)) x(strategy, idx)
WHERE s.role <> 'dropped'""")
cte("rets", "cells", f"""
SELECT *, position * r - cost AS ret FROM (
 SELECT *, 2.0 / 1e4 * abs(position - lag(position, 1, 0) OVER ({P} ORDER BY pos)) AS cost FROM cells)""")


def metrics_sql(source: str, keys: str = "strategy, symbol, path_id", where: str = "role = 'test'") -> str:
    return f"""
SELECT {keys}, n_bars, total_return, sharpe, max_drawdown,
 CASE WHEN down > 0 THEN mean / down * sqrt(252) WHEN mean > 0 THEN NULL ELSE 0 END AS sortino,
 CASE WHEN max_drawdown < 0 THEN mean * 252 / abs(max_drawdown) WHEN mean > 0 THEN NULL ELSE 0 END AS calmar
FROM (SELECT {keys}, count(ret) AS n_bars, sum(ret) AS total_return, avg(ret) AS mean,
  CASE WHEN count(ret) < 2 THEN NULL WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END AS sharpe,
  min(eq / mx - 1) AS max_drawdown,
  CASE WHEN count(*) FILTER (WHERE ret < 0) > 1 THEN stddev_samp(CASE WHEN ret < 0 THEN ret END) END AS down
 FROM (SELECT *, max(eq) OVER (PARTITION BY {keys} ORDER BY pos) AS mx FROM (
  SELECT *, exp(sum(ret) OVER (PARTITION BY {keys} ORDER BY pos)) AS eq FROM {source} WHERE {where})) GROUP BY {keys})"""


cte("metrics", "rets", metrics_sql("rets"))
cte("dist", "metrics", """
SELECT strategy, symbol, count(*) AS n_paths, quantile_cont(sharpe, 0.05) AS sharpe_p05, quantile_cont(sharpe, 0.5) AS sharpe_p50,
 quantile_cont(sharpe, 0.95) AS sharpe_p95, quantile_cont(max_drawdown, 0.05) AS max_dd_p05,
 quantile_cont(max_drawdown, 0.5) AS max_dd_p50, quantile_cont(max_drawdown, 0.95) AS max_dd_p95,
 avg(sharpe) AS sharpe_mean, stddev_samp(sharpe) AS sharpe_std FROM metrics GROUP BY 1, 2""")
cte("perf", "rets", """
SELECT symbol, path_id, strategy, strategy_idx,
 CASE WHEN coalesce(stddev_samp(ret) FILTER (WHERE role = 'train'), 0) > 0 THEN avg(ret) FILTER (WHERE role = 'train') / stddev_samp(ret) FILTER (WHERE role = 'train') * sqrt(252) ELSE 0 END AS is_perf,
 CASE WHEN coalesce(stddev_samp(ret) FILTER (WHERE role = 'test'), 0) > 0 THEN avg(ret) FILTER (WHERE role = 'test') / stddev_samp(ret) FILTER (WHERE role = 'test') * sqrt(252) ELSE 0 END AS oos_perf
FROM rets GROUP BY 1, 2, 3, 4""")
cte("pbo", "perf", """
SELECT symbol, count(*) AS n_paths, avg(CASE WHEN rk / (n + 1.0) < 0.5 THEN 1.0 ELSE 0.0 END) AS pbo FROM (
 SELECT *, row_number() OVER (PARTITION BY symbol, path_id ORDER BY is_perf DESC, strategy_idx) AS best,
  row_number() OVER (PARTITION BY symbol, path_id ORDER BY oos_perf, strategy_idx) AS rk,
  count(*) OVER (PARTITION BY symbol, path_id) AS n FROM perf) WHERE best = 1 GROUP BY symbol""")
# risk limits per (symbol, path, role)
cte("risk_rows", "split", """
SELECT symbol, path_id, role, pos, r, 0 AS seed FROM split WHERE role <> 'dropped' UNION ALL
SELECT symbol, path_id, 'test', pos, r, 1 FROM (SELECT *, row_number() OVER (PARTITION BY symbol, path_id ORDER BY pos DESC) AS rn
 FROM split WHERE role = 'train') WHERE rn <= 60""")
cte("risk", "risk_rows", """
SELECT symbol, path_id, role, pos, CASE WHEN nq >= 5 AND q < 0 THEN 0.02 / abs(q) END AS var_limit,
 coalesce(last_value(crossed IGNORE NULLS) OVER (PARTITION BY symbol, path_id, role ORDER BY seed DESC, pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS halted, seed FROM (
 SELECT *, CASE WHEN eq / mx - 1 < -0.15 THEN true WHEN eq / mx - 1 > -0.075 THEN false END AS crossed FROM (
  SELECT *, max(eq) OVER (PARTITION BY symbol, path_id, role ORDER BY seed DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mx FROM (
   SELECT *, quantile_cont(r, 0.05) OVER w60 AS q, count(r) OVER w60 AS nq,
    coalesce(product(CASE WHEN seed = 0 THEN 1 + r ELSE 1 END) OVER (PARTITION BY symbol, path_id, role ORDER BY seed DESC, pos
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS eq
   FROM risk_rows WINDOW w60 AS (PARTITION BY symbol, path_id, role ORDER BY seed DESC, pos ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))))
""")


def frame(spark, sf, by="flag", extra=()):
    """Backtest frame: features, label horizons and returns, pruned to what strategies read."""
    return tb(spark, sf, by).select("symbol", "pos", "ts", "r", "horizon", "mom_20", *extra)


def split(spark, sf, **kw):
    return folds.cpcv_split(frame(spark, sf), **kw)


def cells(spark, sf, **kw):
    return val.backtest_cells(frame(spark, sf), bt.benchmark_positions(), in_sample=True, **kw)


def rets_and_metrics(spark, sf):
    c = cells(spark, sf).where("role = 'test'")
    return c, bt.path_metrics(c)


# ---- folds ---------------------------------------------------------------------------------------

query("assign_groups", "frame", "SELECT * FROM frame", keys="symbol", ints="pos n_bars group_size group_id")(
    lambda spark, sf: folds.with_groups(frame(spark, sf)))


@query("fold_combinations", "folds frame", """
SELECT symbol, path_id, g1, g2, sum(CASE WHEN group_id IN (g1, g2) THEN 1 ELSE 0 END) AS n_test FROM frame CROSS JOIN folds GROUP BY 1, 2, 3, 4""",
       keys="symbol", ints="path_id g1 g2 n_test")
def fold_combinations(spark, sf):
    s = folds.cpcv_split(frame(spark, sf), test_only=True)
    return s.groupBy("symbol", "path_id", F.col("test_groups")[0].alias("g1"), F.col("test_groups")[1].alias("g2")).agg(
        F.count(F.lit(1)).alias("n_test"))


@query("cpcv_split", "split", "SELECT * FROM split", keys="symbol role", ints="pos path_id")
def cpcv_split(spark, sf):
    return split(spark, sf)


@query("purge_by_horizon", "split", f"""
SELECT symbol, path_id, count(*) AS n_purged, min(pos) AS first_pos, max(pos) AS last_pos FROM split
WHERE group_id NOT IN (g1, g2) AND ({_purge}) GROUP BY 1, 2""", keys="symbol", ints="path_id n_purged first_pos last_pos")
def purge_by_horizon(spark, sf):
    s = split(spark, sf).where(~F.array_contains("test_groups", F.col("group_id")) & folds.purged_by_horizon(10))
    return s.groupBy("symbol", "path_id").agg(F.count(F.lit(1)).alias("n_purged"), F.min("pos").alias("first_pos"),
                                              F.max("pos").alias("last_pos"))


@query("purge_fixed", "split", f"""
SELECT symbol, path_id, pos FROM split WHERE group_id NOT IN (g1, g2) AND ({_fix})""", keys="symbol", ints="path_id pos")
def purge_fixed(spark, sf):
    return split(spark, sf).where(~F.array_contains("test_groups", F.col("group_id")) & folds.purged_fixed(10))


@query("embargo", "split", f"""
SELECT symbol, path_id, pos FROM split WHERE group_id NOT IN (g1, g2) AND ({_emb})""", keys="symbol", ints="path_id pos")
def embargo(spark, sf):
    return split(spark, sf).where(~F.array_contains("test_groups", F.col("group_id")) & folds.embargoed(10, 0.01))


@query("contiguous_blocks", "split", """
SELECT symbol, path_id, min(pos) AS block_start, max(pos) AS block_end FROM (
 SELECT symbol, path_id, pos, pos - row_number() OVER (PARTITION BY symbol, path_id ORDER BY pos) AS island FROM split WHERE role = 'test')
GROUP BY symbol, path_id, island""", keys="symbol", ints="path_id block_start block_end")
def contiguous_blocks(spark, sf):
    return folds.contiguous_blocks(split(spark, sf).where("role = 'test'"), ["symbol", "path_id"])


# ---- backtest ------------------------------------------------------------------------------------


@query("benchmark_positions", "bars_f1", """
SELECT f.symbol, f.pos, x.strategy, CASE x.strategy WHEN 'buy_hold' THEN 1.0 WHEN 'flat' THEN 0.0 ELSE CASE WHEN mom_20 > 0 THEN 1.0 ELSE 0.0 END END AS position
FROM bars_f1 f CROSS JOIN (VALUES ('buy_hold'), ('flat'), ('momentum_20d')) x(strategy)""",
       keys="symbol strategy", ints="pos", floats="position")
def benchmark_positions(spark, sf):
    return bt.fan_out(feat.features_v1(td.bars(spark, sf)), bt.benchmark_positions(), ["symbol", "pos"])


query("gross_return", "cells", "SELECT *, position * r AS gross FROM cells WHERE role = 'test'",
      keys="strategy symbol", ints="path_id pos", floats="gross")(
    lambda spark, sf: cells(spark, sf).where("role = 'test'").withColumn("gross", bt.gross_return()))
query("flat_cost", "rets", "SELECT * FROM rets WHERE strategy = 'momentum_20d'", keys="strategy symbol role",
      ints="path_id pos", floats="cost ret", digits=9)(
    lambda spark, sf: cells(spark, sf).where("strategy = 'momentum_20d'"))


@query("illiquidity_cost", "bars bars_raw", f"""
SELECT symbol, pos, 2.0 * least(greatest(med / volume, 0.5), 3.0) / 1e4 * abs(position - lag(position, 1, 0) OVER {W}) AS cost FROM (
 SELECT b.symbol, b.pos, b.volume, median(b.volume) OVER (PARTITION BY b.symbol) AS med, CASE WHEN r.mom_20 > 0 THEN 1.0 ELSE 0.0 END AS position
 FROM bars b JOIN bars_raw r ON b.symbol = r.symbol AND b.pos = r.pos)""", keys="symbol", ints="pos", floats="cost", digits=9)
def illiquidity_cost(spark, sf):
    df = feat.momentum(feat.with_return(td.bars(spark, sf)))
    df = df.withColumn("position", F.when(F.col("mom_20") > 0, 1.0).otherwise(0.0))
    return df.withColumn("cost", bt.illiquidity_cost(["symbol"]))


def _risk(spark, sf):
    return bt.risk_limits(split(spark, sf))


query("var_gate", "risk", "SELECT * FROM risk WHERE seed = 0", keys="symbol role", ints="path_id pos", floats="var_limit")(_risk)
query("drawdown_breaker", "risk", "SELECT * FROM risk WHERE seed = 0", keys="symbol role halted", ints="path_id pos")(_risk)
_limited = "CASE WHEN k.halted THEN 0 ELSE sign(c.position) * least(abs(c.position), coalesce(k.var_limit, abs(c.position))) END"
cte("risk_cells", "cells risk", f"""
SELECT c.* EXCLUDE (position), {_limited} AS position FROM cells c JOIN risk k
 ON c.symbol = k.symbol AND c.path_id = k.path_id AND c.role = k.role AND c.pos = k.pos AND k.seed = 0""")
query("risk_controls", "risk_cells", "SELECT * FROM risk_cells", keys="strategy symbol role", ints="path_id pos",
      floats="position")(lambda spark, sf: cells(spark, sf, risk=True))


@query("path_metrics", "metrics", "SELECT * FROM metrics", keys="strategy symbol", ints="path_id n_bars",
       floats="total_return sharpe sortino max_drawdown calmar")
def path_metrics(spark, sf):
    return rets_and_metrics(spark, sf)[1]


@query("annualised_sharpe", "bars_r", """
SELECT symbol, CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(252) ELSE 0 END AS sharpe FROM bars_r GROUP BY symbol""",
       keys="symbol", floats="sharpe")
def annualised_sharpe(spark, sf):
    return bt.annualised_sharpe(feat.with_return(td.bars(spark, sf)), ["symbol"], "r")


DIST = "sharpe_p05 sharpe_p50 sharpe_p95 max_dd_p05 max_dd_p50 max_dd_p95 sharpe_mean sharpe_std"
query("path_distribution", "dist", "SELECT * FROM dist", keys="strategy symbol", ints="n_paths", floats=DIST)(
    lambda spark, sf: bt.path_distribution(rets_and_metrics(spark, sf)[1]))
cte("median_path", "metrics", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy, symbol ORDER BY sharpe, path_id) AS rn,
 count(*) OVER (PARTITION BY strategy, symbol) AS n FROM metrics WHERE sharpe IS NOT NULL) WHERE rn = n // 2 + 1""")
query("median_path", "median_path", "SELECT * FROM median_path", keys="strategy symbol", ints="path_id", floats="sharpe")(
    lambda spark, sf: bt.median_path(rets_and_metrics(spark, sf)[1]))

_a = "abs(z)"
_ser = "1.0"
for _k in range(75, 0, -1):
    _ser = f"(1.0+{_ser}*a2/{2 * _k + 1})"
cte("dsr", "rets median_path", f"""
SELECT strategy, symbol, n_returns, CASE WHEN s = 0 THEN 0 ELSE least(greatest(0.5 + sign(z) * z_abs * exp(-a2/2) / sqrt(2*pi()) * {_ser}, 0), 1) END AS dsr_p_value,
 CASE WHEN s = 0 THEN 0 ELSE sr * sqrt(252) END AS dsr_sharpe
FROM (SELECT *, abs(z) AS z_abs, z * z AS a2 FROM (
 SELECT *, sr * sqrt(252) / sqrt(greatest((1 - g3 * sr + (g4 - 1) / 4 * sr * sr) / (n_returns - 1) * 252, 1e-12)) - {stats.expected_max_z(50)!r} AS z FROM (
  SELECT r.strategy, r.symbol, count(*) AS n_returns, stddev_samp(ret) AS s, avg(ret) / nullif(stddev_samp(ret), 0) AS sr,
   CASE WHEN stddev_samp(ret) > 0 THEN skewness(ret) END AS g3, CASE WHEN stddev_samp(ret) > 0 THEN kurtosis(ret) + 3 END AS g4
  FROM rets r JOIN median_path m ON r.strategy = m.strategy AND r.symbol = m.symbol AND r.path_id = m.path_id
  WHERE r.role = 'test' GROUP BY 1, 2)))""")


@query("deflated_sharpe", "dsr", "SELECT * FROM dsr", keys="strategy symbol", ints="n_returns", floats="dsr_p_value dsr_sharpe")
def deflated_sharpe(spark, sf):
    """Median path of every strategy; the twin's CDF is the power series, valid for |z| < 5."""
    c, m = rets_and_metrics(spark, sf)
    rets = c.join(bt.median_path(m).select("strategy", "symbol", "path_id"), ["strategy", "symbol", "path_id"], "left_semi")
    return stats.deflated_sharpe(rets, ["strategy", "symbol"], 50)


query("pbo", "pbo", "SELECT * FROM pbo", keys="symbol", ints="n_paths", floats="pbo")(
    lambda spark, sf: stats.overfitting_probability(val.performance_matrix(cells(spark, sf))))
query("cpcv_validate", "dist dsr", """
SELECT d.*, s.dsr_p_value, s.dsr_sharpe FROM dist d JOIN dsr s ON d.strategy = s.strategy AND d.symbol = s.symbol WHERE d.strategy = 'momentum_20d'""",
      keys="strategy symbol", ints="n_paths", floats=DIST + " dsr_p_value dsr_sharpe")(
    lambda spark, sf: val.validate(frame(spark, sf), "momentum_20d", bt.benchmark_positions()["momentum_20d"]))
query("cpcv_validate_multi", "dist dsr pbo", """
SELECT d.*, s.dsr_p_value, s.dsr_sharpe, p.pbo FROM dist d JOIN dsr s ON d.strategy = s.strategy AND d.symbol = s.symbol JOIN pbo p ON d.symbol = p.symbol""",
      keys="strategy symbol", ints="n_paths", floats=DIST + " dsr_p_value dsr_sharpe pbo")(
    lambda spark, sf: val.validate_many(frame(spark, sf), bt.benchmark_positions()))
cte("risk_rets", "risk_cells", f"""
SELECT *, position * r - cost AS ret FROM (
 SELECT *, 2.0 / 1e4 * abs(position - lag(position, 1, 0) OVER ({P} ORDER BY pos)) AS cost FROM risk_cells)""")
cte("risk_metrics", "risk_rets", metrics_sql("risk_rets"))
query("cpcv_validate_risk", "risk_metrics", "SELECT * FROM risk_metrics", keys="strategy symbol", ints="path_id n_bars",
      floats="total_return sharpe sortino max_drawdown calmar")(
    lambda spark, sf: bt.path_metrics(cells(spark, sf, risk=True).where("role = 'test'")))

# strategies that see the folds: row-local ones, blends, and a ridge fitted on each path's train rows
_vol = "CASE WHEN vol_ewma * sqrt(252) > 1e-9 THEN vol_ewma * sqrt(252) END"
cte("p_base", "split", f"""
SELECT *, 1.0::DOUBLE AS b0, CASE WHEN mom_20 > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS b1, coalesce(least(greatest(0.14 / {_vol}, 0), 1), 0)::DOUBLE AS b2
FROM split WHERE role <> 'dropped'""")
cte("p_ridge", "p_base", """
SELECT *, (sy - s1 * w1 - s2 * w2) / n AS w0 FROM (
 SELECT *, (a22 * y1 - a12 * y2) / (a11 * a22 - a12 * a12) AS w1, (a11 * y2 - a12 * y1) / (a11 * a22 - a12 * a12) AS w2 FROM (
  SELECT symbol, path_id, count(*) AS n, sum(r) AS sy, sum(b1) AS s1, sum(b2) AS s2, sum(b1 * b1) - sum(b1) * sum(b1) / count(*) + 1 AS a11,
   sum(b1 * b2) - sum(b1) * sum(b2) / count(*) AS a12, sum(b2 * b2) - sum(b2) * sum(b2) / count(*) + 1 AS a22,
   sum(b1 * r) - sum(b1) * sum(r) / count(*) AS y1, sum(b2 * r) - sum(b2) * sum(r) / count(*) AS y2
  FROM p_base WHERE role = 'train' AND r IS NOT NULL GROUP BY 1, 2))""")
cte("p_cells", "p_base p_ridge risk", """
SELECT symbol, path_id, role, pos, r, strategy, strategy_idx, CASE WHEN halted THEN 0 ELSE sign(p) * CASE WHEN var_limit IS NULL THEN abs(p) ELSE least(abs(p), var_limit) END END AS position FROM (
 SELECT b.symbol, b.path_id, b.role, b.pos, b.r, k.var_limit, k.halted, x.strategy, x.strategy_idx, CASE x.strategy_idx WHEN 0 THEN b0 WHEN 1 THEN b1 WHEN 2 THEN b2
  WHEN 3 THEN least(greatest((b0 + b1 + b2) / 3, -1), 1) ELSE least(greatest(100 * (w0 + w1 * b1 + w2 * b2), -1), 1) END AS p
 FROM p_base b JOIN p_ridge g ON b.symbol = g.symbol AND b.path_id = g.path_id
 JOIN risk k ON b.symbol = k.symbol AND b.path_id = k.path_id AND b.role = k.role AND b.pos = k.pos AND k.seed = 0
 CROSS JOIN (VALUES ('buy_hold', 0), ('momentum_20d', 1), ('vol_target', 2), ('equal_blend', 3), ('ridge_blend', 4)) x(strategy, strategy_idx))""")
cte("p_rets", "p_cells", f"""
SELECT *, position * r - cost AS ret FROM (
 SELECT *, 2.0 / 1e4 * abs(position - lag(position, 1, 0) OVER ({P} ORDER BY pos)) AS cost FROM p_cells)""")
_chain = ["rets", "metrics", "dist", "perf", "pbo", "median_path", "dsr"]
for _n in _chain[1:]:
    _deps, _body = CTES[_n]
    cte(f"p_{_n}", " ".join(f"p_{d}" if d in _chain else d for d in _deps.split()),
        re.sub(rf"\b(FROM|JOIN) ({'|'.join(_chain)})\b", r"\1 p_\2", _body))


def panel_strategies(fitted: bool = False) -> dict:
    """Name to strategy: benchmarks, variance targeting, equal and ridge blends; with ``fitted`` the stabilised rule too."""
    b1, b2 = F.when(F.col("mom_20") > 0, 1.0).otherwise(0.0), vol_target_position("vol_ewma")

    def blend(view):
        return val.row_strategy(clip((1.0 + b1 + b2) / 3, -1.0, 1.0))(view)

    def ridge(view):
        wide = view.select(*val.CELL, "r", b1.alias("b1"), b2.alias("b2"))
        return ridge_blend(wide, ["b1", "b2"], ["symbol", "path_id"])

    def rule(view):
        return rg.rule_positions(view, S.FEATURES_V1)

    out = {"buy_hold": val.row_strategy(F.lit(1.0)), "momentum_20d": val.row_strategy(b1), "vol_target": val.row_strategy(b2),
           "equal_blend": blend, "ridge_blend": ridge}
    return out | ({"rule": rule} if fitted else {})


PANEL = dict(keys="strategy symbol", ints="n_paths", floats=DIST + " dsr_p_value dsr_sharpe pbo")


@query("cpcv_panel", "p_dist p_dsr p_pbo", """
SELECT d.*, s.dsr_p_value, s.dsr_sharpe, p.pbo FROM p_dist d JOIN p_dsr s ON d.strategy = s.strategy AND d.symbol = s.symbol JOIN p_pbo p ON d.symbol = p.symbol""", **PANEL)
def cpcv_panel(spark, sf):
    """Five strategies through 10 groups with horizons, limits and costs, in and out of sample."""
    return val.validate_panel(frame(spark, sf, extra=("vol_ewma",)), panel_strategies())


@query("cpcv_panel_rule", **PANEL)
def cpcv_panel_rule(spark, sf):
    """The same panel with the stabilised rule regimes, whose state starts in each path's train rows."""
    extra = [c for c in S.FEATURES_V1 if c != "mom_20"]
    return val.validate_panel(frame(spark, sf, extra=extra), panel_strategies(fitted=True))


@query("cpcv_panel_fitted", **PANEL)
def cpcv_panel_fitted(spark, sf):
    """Eleven strategies on shared folds: benchmarks, blends, the rule, and five that fit on each path's train rows."""
    extra = [c for c in S.FEATURES_V1 if c != "mom_20"]
    labels = rg.raw_regimes(feat.features_v1(td.bars(spark, sf))).select(
        "symbol", "ts", F.col("label").alias("rule_label"), "p_0", "p_1", "p_2")
    rows = stored(frame(spark, sf, extra=extra).join(labels, ["symbol", "ts"]))
    return val.validate_panel(rows, panel_strategies(fitted=True) | strategies.fitted_strategies())


# a universe of series: one per supplier, five groups
cte("s_labels0", "sbars_f1", """
SELECT symbol, pos, r, close, mom_20, vol_ewma, max(pos) OVER (PARTITION BY symbol) AS last_pos, count(*) OVER (PARTITION BY symbol) AS n_bars,
 close * (1 + 2.0 * vol_ewma) AS up, close * (1 - 2.0 * vol_ewma) AS lo FROM sbars_f1""")
cte("s_test", "s_labels0 folds", """
SELECT f.symbol, f.pos, f.r, p.path_id, CASE WHEN f.mom_20 > 0 THEN 1.0 ELSE 0.0 END AS position, 'test' AS role, 'momentum_20d' AS strategy
FROM s_labels0 f JOIN (SELECT row_number() OVER (ORDER BY g1, g2) - 1 AS path_id, g1, g2 FROM folds WHERE g2 < 5) p
 ON least(f.pos // (f.n_bars // 5), 4) IN (p.g1, p.g2) WHERE f.n_bars >= 250""")
cte("s_rets", "s_test", f"""
SELECT *, position * r - 2.0 / 1e4 * abs(position - lag(position, 1, 0) OVER ({P} ORDER BY pos)) AS ret FROM s_test""")
cte("s_metrics", "s_rets", metrics_sql("s_rets"))
cte("s_eval", "s_metrics s_labels0", """
SELECT c.symbol, c.n_bars, CASE WHEN c.n_bars < 250 THEN format('only {} bars, need at least 250', c.n_bars) END AS error,
 m.n_paths, m.sharpe_p05, m.sharpe_p50, m.sharpe_p95, m.max_dd_p50
FROM (SELECT symbol, count(*) AS n_bars FROM s_labels0 GROUP BY 1) c LEFT JOIN (
 SELECT symbol, count(*) AS n_paths, quantile_cont(sharpe, 0.05) AS sharpe_p05, quantile_cont(sharpe, 0.5) AS sharpe_p50,
  quantile_cont(sharpe, 0.95) AS sharpe_p95, quantile_cont(max_drawdown, 0.5) AS max_dd_p50 FROM s_metrics GROUP BY 1) m
ON c.symbol = m.symbol""")


def evaluated(spark, sf):
    f = feat.features_v1(td.bars(spark, sf, "supplier")).select("symbol", "pos", "r", "mom_20")
    return val.evaluate_assets(f, "momentum_20d", bt.benchmark_positions()["momentum_20d"], n_splits=5)


query("evaluate_assets", "s_eval", "SELECT * FROM s_eval", keys="symbol error", ints="n_bars n_paths",
      floats="sharpe_p05 sharpe_p50 sharpe_p95 max_dd_p50")(evaluated)


@query("robustness_summary", "s_eval", """
SELECT *, n_assets - n_evaluated AS n_failed, n_positive / n_evaluated AS fraction_positive,
 n_positive / n_evaluated >= 0.7 AND mean_sharpe > 0 AS passes_gate FROM (
 SELECT count(*) AS n_assets, count(sharpe_p50) AS n_evaluated, count(*) FILTER (WHERE sharpe_p50 > 0) AS n_positive,
  avg(sharpe_p50) AS mean_sharpe, median(sharpe_p50) AS median_sharpe FROM s_eval)""", keys="passes_gate",
       ints="n_assets n_evaluated n_failed n_positive", floats="fraction_positive mean_sharpe median_sharpe")
def robustness_summary(spark, sf):
    return val.robustness_summary(evaluated(spark, sf))


query("select_winner", "dist", """
SELECT symbol, strategy, sharpe_p50, n_tied FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY
  CASE WHEN n_tied > 1 AND strategy = 'momentum_20d' THEN 0 ELSE 1 END, sharpe_p50 DESC, strategy) AS rn FROM (
 SELECT *, count(*) OVER (PARTITION BY symbol) AS n_tied FROM (
  SELECT *, max(sharpe_p50) OVER (PARTITION BY symbol) AS top FROM dist) WHERE top - sharpe_p50 <= 0.10)) WHERE rn = 1""",
      keys="symbol strategy", ints="n_tied", floats="sharpe_p50")(
    lambda spark, sf: bt.select_winner(bt.path_distribution(rets_and_metrics(spark, sf)[1]), ["momentum_20d"]))


@query("equity_curves", "bars_f1", f"""
SELECT symbol, pos, eq_mom / first_value(eq_mom) OVER {W} AS eq_mom, eq_half / first_value(eq_half) OVER {W} AS eq_half, eq_bh / first_value(eq_bh) OVER {W} AS eq_bh
FROM (SELECT *, exp(sum(rr * coalesce(lag_m, 0)) OVER {W}) AS eq_mom, exp(sum(rr * coalesce(lag_h, 0)) OVER {W}) AS eq_half,
  exp(sum(rr) OVER {W}) AS eq_bh, row_number() OVER (PARTITION BY symbol ORDER BY pos DESC) AS rn FROM (
  SELECT symbol, pos, coalesce(r, 0) AS rr, lag(CASE WHEN mom_20 > 0 THEN 1.0 ELSE 0.0 END) OVER {W} AS lag_m,
   lag(CASE WHEN mom_63 > 0 THEN 0.5 ELSE -0.5 END) OVER {W} AS lag_h FROM bars_f1)) WHERE rn <= 504""",
       keys="symbol", ints="pos", floats="eq_mom eq_half eq_bh")
def equity_curves(spark, sf):
    f = feat.features_v1(td.bars(spark, sf)).withColumns({
        "p1": F.when(F.col("mom_20") > 0, 1.0).otherwise(0.0), "p2": F.when(F.col("mom_63") > 0, 0.5).otherwise(-0.5)})
    return bt.equity_curves(f, {"mom": "p1", "half": "p2"})


@query("forecast_rmse", "bars_f1", f"""
SELECT symbol, count(*) AS n, sqrt(avg(pow(target - model, 2))) AS model_rmse, sqrt(avg(pow(target - bench, 2))) AS rolling_rmse,
 sqrt(avg(pow(target - model, 2))) < sqrt(avg(pow(target - bench, 2))) AS passes_gate FROM (
 SELECT symbol, abs(lead(r) OVER {W}) AS target, vol_ewma AS model, lag(v) OVER {W} AS bench FROM (
  SELECT *, {roll('stddev_samp', 'r', 21)} AS v FROM bars_f1)) WHERE target IS NOT NULL AND bench IS NOT NULL GROUP BY symbol""",
       keys="symbol passes_gate", ints="n", floats="model_rmse rolling_rmse")
def forecast_rmse(spark, sf):
    return bt.forecast_rmse(feat.features_v1(td.bars(spark, sf)), "vol_ewma")


@query("lookahead_check", "bars bars_f1", f"""
SELECT b.symbol, o.output, 10 AS n_samples, 0 AS n_violations, true AS passed
FROM (SELECT DISTINCT symbol FROM bars) b, (SELECT unnest({[*S.FEATURES_V1, "label", "p_0", "p_1", "p_2"]!r}) AS output) o""",
       keys="symbol output passed", ints="n_samples n_violations")
def lookahead_check(spark, sf):
    """Every shipped price feature and the stabilised rule regimes, probed with perturbed futures."""
    def op(df):
        f = feat.features_v1(df)
        seq = rg.rule_sequence(f).select("symbol", "pos", "p_0", "p_1", "p_2", "label")
        return f.join(seq, ["symbol", "pos"])
    return val.lookahead_check(stored(td.bars(spark, sf)), op, [*S.FEATURES_V1, "label", "p_0", "p_1", "p_2"], ["close"])


@query("momentum_backtest", "bars_raw", f"""
SELECT symbol, n_bars, total_return, sharpe, sortino, max_drawdown, calmar FROM ({metrics_sql(f'''(SELECT 'momentum_20d' AS strategy, symbol, 0 AS path_id, pos, 'test' AS role,
 position * r - 2.0 / 1e4 * abs(position - lag(position, 1, 0) OVER {W}) AS ret FROM (SELECT *, CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END AS position FROM (
  SELECT *, lag(mom_20) OVER {W} AS m FROM bars_raw)) QUALIFY ret IS NOT NULL) AS x''')})""",
       keys="symbol", ints="n_bars", floats="total_return sharpe sortino max_drawdown calmar")
def momentum_backtest(spark, sf):
    """Raw line items to per-series performance of the lagged momentum rule, net of costs."""
    df = feat.lagged(feat.momentum(feat.with_return(td.bars(spark, sf))), ["mom_20"])
    df = df.select("symbol", "pos", "r", F.when(F.col("mom_20") > 0, 1.0).otherwise(0.0).alias("position"),
                   F.lit("momentum_20d").alias("strategy"), F.lit(0).alias("path_id"), F.lit("test").alias("role"))
    return bt.path_metrics(bt.strategy_returns(df))
