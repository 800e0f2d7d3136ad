"""Models, payloads and streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import frame as fr
from ..functions.store import scratch, stored

from ..models import classifier as clf
from ..models import filters as flt
from ..models import mixture as mix
from ..models import volatility as vol
from ..operators import drift
from ..operators import features as feat
from ..operators import folds
from ..operators import labels as lab
from ..operators import regimes as rg
from ..operators.realised import intraday_returns
from ..plans import snapshot as snap
from ..plans import validation as val
from ..operators import backtest as bt
from ..sources import sinks
from ..sources import testdata as td
from ..streaming import live
from .base import query
from .core import tb
from .regime import FUSED, models, raw
from .sql import W, cte
from .trading import cells, frame


def pairs(spark, sf):
    return feat.mixture_inputs(td.bars(spark, sf))


@query("hmm_forward_filter", "bars_f1", f"""
WITH RECURSIVE z AS (SELECT symbol, pos, row_number() OVER {W} AS rn, exp(-0.5 * power(z / 0.6, 2)) / 0.6 AS e0, exp(-0.5 * power(z / 1.6, 2)) / 1.6 AS e1
 FROM (SELECT symbol, pos, r / nullif(vol_yearly, 0) AS z FROM bars_f1) WHERE z IS NOT NULL),
f AS (SELECT symbol, pos, rn, e0 / (e0 + e1) AS p0, e1 / (e0 + e1) AS p1 FROM z WHERE rn = 1 UNION ALL
 SELECT symbol, pos, rn, a / (a + b), b / (a + b) FROM (SELECT z.symbol, z.pos, z.rn, (f.p0 * 0.97 + f.p1 * 0.05) * z.e0 AS a, (f.p0 * 0.03 + f.p1 * 0.95) * z.e1 AS b
  FROM f JOIN z ON z.symbol = f.symbol AND z.rn = f.rn + 1))
SELECT symbol, pos, p0 AS p_calm, p1 AS p_wild FROM f""", keys="symbol", ints="pos", floats="p_calm p_wild")
def hmm_forward_filter(spark, sf):
    """Two volatility states with fixed parameters over standardised returns."""
    df = feat.features_v1(td.bars(spark, sf)).select("symbol", "pos", (F.col("r") / F.nullif("vol_yearly", F.lit(0.0))).alias("z"))
    density = F.array(*[-0.5 * F.pow(F.col("z") / s, 2) - F.ln(F.lit(s)) for s in (0.6, 1.6)])
    out = flt.hmm_forward_filter(df.where("z IS NOT NULL").withColumn("log_emit", density), [[0.97, 0.03], [0.05, 0.95]], [0.5, 0.5])
    return out.select("symbol", "pos", F.col("probs")[0].alias("p_calm"), F.col("probs")[1].alias("p_wild"))


@query("likeliest_path", "bars_f1", f"""
WITH RECURSIVE z AS (SELECT symbol, pos, row_number() OVER {W} AS rn, -0.5 * power(z / 0.6, 2) - ln(0.6) AS e0, -0.5 * power(z / 1.6, 2) - ln(1.6) AS e1
 FROM (SELECT symbol, pos, r / nullif(vol_yearly, 0) AS z FROM bars_f1) WHERE z IS NOT NULL),
f AS (SELECT symbol, rn, ln(0.5) + e0 AS s0, ln(0.5) + e1 AS s1, [0] AS p0, [1] AS p1 FROM z WHERE rn = 1 UNION ALL
 SELECT z.symbol, z.rn, greatest(f.s0 + ln(0.97), f.s1 + ln(0.05)) + z.e0, greatest(f.s0 + ln(0.03), f.s1 + ln(0.95)) + z.e1,
  list_append(CASE WHEN f.s0 + ln(0.97) >= f.s1 + ln(0.05) THEN f.p0 ELSE f.p1 END, 0),
  list_append(CASE WHEN f.s0 + ln(0.03) >= f.s1 + ln(0.95) THEN f.p0 ELSE f.p1 END, 1)
 FROM f JOIN z ON z.symbol = f.symbol AND z.rn = f.rn + 1),
best AS (SELECT symbol, arg_max(CASE WHEN s0 >= s1 THEN p0 ELSE p1 END, rn) AS p FROM f GROUP BY symbol)
SELECT z.symbol, z.pos, best.p[z.rn] AS state FROM z JOIN best ON z.symbol = best.symbol""", keys="symbol", ints="pos state")
def likeliest_path(spark, sf):
    """The most likely states of the filter above, with the same fixed parameters."""
    df = feat.features_v1(td.bars(spark, sf)).select("symbol", "pos", (F.col("r") / F.nullif("vol_yearly", F.lit(0.0))).alias("z"))
    density = F.array(*[-0.5 * F.pow(F.col("z") / s, 2) - F.ln(F.lit(s)) for s in (0.6, 1.6)])
    return flt.likeliest_path(df.where("z IS NOT NULL").withColumn("log_emit", density), [[0.97, 0.03], [0.05, 0.95]], [0.5, 0.5])


query("fit_regime_mixture")(lambda spark, sf: mix.regime_mixture(pairs(spark, sf)))
query("fit_regime_mixture_train")(lambda spark, sf: mix.regime_mixture(
    flt.train_share(pairs(spark, sf), 0.7), train_only=True))
query("select_k")(lambda spark, sf: mix.select_k(pairs(spark, sf)))
query("state_path")(lambda spark, sf: mix.regime_mixture(pairs(spark, sf), iterations=100, path=True).select("symbol", "pos", "state"))

cte("garch", "bars_r", f"""
SELECT t.symbol, t.pos, sum(pow(0.9, t.pos - i.pos) * CASE WHEN i.pos = 0 THEN 1.0 ELSE 0.02 + 0.08 * coalesce(i.x * i.x, 0) END) AS sigma2
FROM bars_r t JOIN (SELECT symbol, pos, lag(100 * r) OVER {W} AS x FROM bars_r) i ON t.symbol = i.symbol AND i.pos <= t.pos GROUP BY 1, 2""")


@query("garch_variance", "garch", "SELECT *, sqrt(sigma2) / 100 AS sigma FROM garch", keys="symbol", ints="pos", floats="sigma2 sigma")
def garch_variance(spark, sf):
    df = feat.with_return(td.bars(spark, sf)).select("symbol", "pos", F.coalesce("r", F.lit(0.0)).alias("r"))
    par = {"omega": 0.02, "alpha": 0.08, "beta": 0.9, "sigma2_0": 1.0}
    return vol.garch_volatility(df.withColumns({k: F.lit(v) for k, v in par.items()}))


query("fit_garch")(lambda spark, sf: vol.fit_garch(feat.with_return(td.bars(spark, sf))))
query("vol_target_position", "bars_f1", """
SELECT symbol, pos, coalesce(least(greatest(0.14 / CASE WHEN vol_ewma * sqrt(252) > 1e-9 THEN vol_ewma * sqrt(252) END, 0), 1), 0) AS position FROM bars_f1""",
      keys="symbol", ints="pos", floats="position")(
    lambda spark, sf: feat.features_v1(td.bars(spark, sf)).withColumn("position", vol.vol_target_position("vol_ewma")))


def _switching(spark, sf, share=0.7):
    df = feat.with_return(td.bars(spark, sf)).where("r IS NOT NULL")
    return mix.switching_ar(flt.train_share(fr.with_pos(df.select("symbol", "ts", "r")), share))


query("fit_switching_ar")(_switching)


@query("switching_ar_filter")
def switching_ar_filter(spark, sf):
    """Filtered probabilities on all bars from parameters of the first half."""
    return _switching(spark, sf, 0.5)


query("switching_position", "models", f"""
SELECT symbol, pos, coalesce(lag(p_low * 1.0 + p_high * (-0.3)) OVER {W}, 0) AS position FROM models""", keys="symbol", ints="pos", floats="position")(
    lambda spark, sf: flt.lagged_position(models(spark, sf), ["p_low", "p_high"], S.SWITCHING_ALLOC))
query("hsmm_position", "models", """
SELECT symbol, pos, fusion_p0 * 1.0 + fusion_p1 * 0.0 + fusion_p2 * (-0.5) AS position FROM models""", keys="symbol", ints="pos", floats="position")(
    lambda spark, sf: flt.lagged_position(models(spark, sf), FUSED, S.K3_ALLOC, lag=0))
query("hsmm_position_k4", "models", """
SELECT symbol, pos, p_low * p_0 * 1.0 + p_low * (1 - p_0) * 0.5 + p_high * (1 - p_2) * (-0.25) + p_high * p_2 * (-0.5) AS position FROM models""",
      keys="symbol", ints="pos", floats="position")(
    lambda spark, sf: flt.lagged_position(models(spark, sf).withColumns({
        "k0": F.col("p_low") * F.col("p_0"), "k1": F.col("p_low") * (1 - F.col("p_0")), "k2": F.col("p_high") * (1 - F.col("p_2")),
        "k3": F.col("p_high") * F.col("p_2")}), ["k0", "k1", "k2", "k3"], S.K4_ALLOC, lag=0))
cte("durations", "runs", """
SELECT b.symbol, b.label, n_runs, CASE WHEN n_runs < 3 THEN 1.0 ELSE s.shape END AS shape, CASE WHEN n_runs < 3 THEN greatest(mean, 1.0) ELSE s.scale END AS scale
FROM (SELECT symbol, label, count(*) AS n_runs, avg(run_len) AS mean FROM runs GROUP BY 1, 2) b JOIN (
 SELECT symbol, label, arg_max(shape, ll) AS shape, arg_max(scale, ll) AS scale FROM (
  SELECT *, n * ln(shape) - n * shape * ln(scale) + (shape - 1) * ld - n AS ll FROM (
   SELECT symbol, label, shape, count(*) AS n, pow(avg(pow(run_len::DOUBLE, shape)), 1 / shape) AS scale, sum(ln(run_len::DOUBLE)) AS ld
   FROM runs, (SELECT round(0.3 + 0.05 * i, 2)::DOUBLE AS shape FROM range(75) t(i)) GROUP BY 1, 2, 3)) GROUP BY 1, 2) s
ON b.symbol = s.symbol AND b.label = s.label""")
query("fit_durations", "durations", "SELECT * FROM durations", keys="symbol", ints="label n_runs", floats="shape scale")(
    lambda spark, sf: vol.fit_durations(raw(spark, sf)))


@query("remaining_duration", "durations persist", """
SELECT *, CASE WHEN exp(-z) >= 1e-9 THEN list_sum(list_transform(range(400), lambda i: exp(-(i + 0.5) * 0.1::DOUBLE) * (
 scale * pow(z + (i + 1) * 0.1::DOUBLE, 1 / shape) - scale * pow(z + i * 0.1::DOUBLE, 1 / shape)))) END AS remaining
FROM (SELECT p.symbol, p.label, p.streak, d.n_runs, d.shape, d.scale, pow(p.streak / d.scale, d.shape) AS z
 FROM persist p JOIN durations d ON p.symbol = d.symbol AND p.label = d.label)""", keys="symbol", ints="label streak n_runs", floats="shape scale remaining")
def remaining_duration(spark, sf):
    """Expected bars left in the current regime from its fitted duration law."""
    labels = raw(spark, sf).select("symbol", "pos", "label")
    now = rg.regime_persistence(labels).select("symbol", "label", "streak")
    return now.join(vol.fit_durations(labels), ["symbol", "label"]).withColumn(
        "remaining", vol.remaining_duration(F.col("shape"), F.col("scale"), F.col("streak")))


CLF = S.FEATURES_V1


def training(spark, sf):
    w = lab.sample_weights(tb(spark, sf))
    return flt.train_share(w, 0.7)


def _fitted(spark, sf):
    rows = stored(training(spark, sf))
    model = clf.BarrierClassifier(CLF).fit(rows.where("is_train"))
    return model, rows


@query("fit_barrier_classifier")
def fit_barrier_classifier(spark, sf):
    model, rows = _fitted(spark, sf)
    return model.predict(rows.where("NOT is_train")).select("symbol", "pos", "label", "q_down", "q_flat", "q_up", "position")


query("signed_position", "models", "SELECT symbol, pos, fusion_p2 - fusion_p0 AS position FROM models", keys="symbol", ints="pos", floats="position")(
    lambda spark, sf: models(spark, sf).withColumn("position", clf.signed_position("fusion_p2", "fusion_p0")))


@query("feature_importance")
def feature_importance(spark, sf):
    model, rows = _fitted(spark, sf)
    return spark.createDataFrame(model.importance(), "feature string, importance double")


@query("tune_classifier")
def tune_classifier(spark, sf):
    """The small grid over five purged inner folds, all features, uniqueness weights."""
    split = stored(folds.cpcv_split(stored(lab.sample_weights(tb(spark, sf))), n_splits=5, n_test=1))
    return clf.tune(split, CLF)


@query("fit_transition_detector")
def fit_transition_detector(spark, sf):
    rows = stored(flt.train_share(lab.transition_target(raw(spark, sf)), 0.7))
    det = clf.TransitionDetector([*CLF, "p_0", "p_1", "p_2"]).fit(rows.where("is_train"))
    return det.predict(rows.where("NOT is_train")).select("symbol", "pos", "target", "p_change")


query("equal_blend", "cells", """
SELECT symbol, path_id, pos, least(greatest(avg(position), -1), 1) AS position FROM cells WHERE role = 'test' GROUP BY 1, 2, 3""",
      keys="symbol", ints="path_id pos", floats="position")(
    lambda spark, sf: clf.equal_blend(cells(spark, sf).where("role = 'test'"), ["symbol", "path_id", "pos"]))


@query("ridge_blend", "p_base", """
SELECT b.symbol, b.path_id, b.role, b.pos, least(greatest(100 * (w0 + w1 * b0 + w2 * b1), -1), 1) AS position FROM p_base b JOIN (
 SELECT *, (sy - s1 * w1 - s2 * w2) / n AS w0 FROM (
  SELECT *, (a22 * y1 - a12 * y2) / (a11 * a22 - a12 * a12) AS w1, (a11 * y2 - a12 * y1) / (a11 * a22 - a12 * a12) AS w2 FROM (
   SELECT symbol, path_id, count(*) AS n, sum(r) AS sy, sum(b0) AS s1, sum(b1) AS s2, sum(b0 * b0) - sum(b0) * sum(b0) / count(*) + 1 AS a11,
    sum(b0 * b1) - sum(b0) * sum(b1) / count(*) AS a12, sum(b1 * b1) - sum(b1) * sum(b1) / count(*) + 1 AS a22,
    sum(b0 * r) - sum(b0) * sum(r) / count(*) AS y1, sum(b1 * r) - sum(b1) * sum(r) / count(*) AS y2
   FROM p_base WHERE role = 'train' AND r IS NOT NULL GROUP BY 1, 2))) g ON b.symbol = g.symbol AND b.path_id = g.path_id
WHERE b.role = 'test'""", keys="symbol role", ints="path_id pos", floats="position")
def ridge_blend(spark, sf):
    """Ridge of returns on the momentum and buy-and-hold positions per symbol and path."""
    split = folds.cpcv_split(frame(spark, sf)).where("role <> 'dropped'").withColumns({
        e: c for e, c in bt.benchmark_positions().items() if e != "flat"})
    return clf.ridge_blend(split, ["buy_hold", "momentum_20d"], ["symbol", "path_id"]).where("role = 'test'")


@query("fusion_position")
def fusion_position(spark, sf):
    """Mixture pooled with switching-AR states through a learned mapping, traded one bar later."""
    p = flt.train_share(pairs(spark, sf), 0.7)
    m = mix.regime_mixture(p, train_only=True).drop("label")
    sw = mix.switching_ar(p)
    both = m.join(sw, ["symbol", "pos"]).join(p.select("symbol", "pos", "ts", "is_train"), ["symbol", "pos"])
    labels = raw(spark, sf).select("symbol", "ts", "label")
    mapping = rg.state_mapping(both.where("is_train").join(labels, ["symbol", "ts"]))
    fused = rg.fuse(both, mapping)
    return flt.lagged_position(fused, FUSED, S.K3_ALLOC).where("NOT is_train").select("symbol", "pos", *FUSED, "position")


# adaptive conformal sets, bar by bar: state is the list of the newest 500 scores and the miscoverage rate
for _n, _learn in (("conf", "true"), ("conf70", "pos < floor(n_bars * 0.7)")):
    cte(_n, "models", f"""
WITH RECURSIVE z AS (SELECT *, {_learn} AS learns FROM (SELECT symbol, pos, ts, row_number() OVER {W} AS rn, count(*) OVER (PARTITION BY symbol) AS n_bars,
 fusion_p0 AS a, fusion_p1 AS b, fusion_p2 AS c, label AS y FROM models)),
f AS (SELECT DISTINCT symbol, -1::BIGINT AS pos, 0::BIGINT AS rn, []::DOUBLE[] AS scores, 0.1::DOUBLE AS rate, 0::DOUBLE AS c_0, 0::DOUBLE AS c_1, 0::DOUBLE AS c_2, 0 AS set_size, true AS covered FROM z
 UNION ALL
 SELECT symbol, pos, rn, CASE WHEN learns THEN list_append(scores, 1 - py)[-500:] ELSE scores END,
  CASE WHEN learns THEN least(greatest(rate + 0.005 * (CASE WHEN covered THEN 0.1 ELSE -0.9 END), 1e-6), 1 - 1e-6) ELSE rate END,
  CASE WHEN mass > 0 THEN a * in_a / mass ELSE a END, CASE WHEN mass > 0 THEN b * in_b / mass ELSE b END, CASE WHEN mass > 0 THEN c * in_c / mass ELSE c END,
  in_a + in_b + in_c, covered FROM (
  SELECT *, a * in_a + b * in_b + c * in_c AS mass, CASE y WHEN 0 THEN in_a WHEN 1 THEN in_b ELSE in_c END = 1 AS covered,
   CASE y WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS py FROM (
   SELECT *, (1 - a <= q)::INT AS in_a, (1 - b <= q)::INT AS in_b, (1 - c <= q)::INT AS in_c FROM (
    SELECT *, CASE WHEN len(scores) >= 30 THEN s[lo + 1] + (s[least(lo + 2, len(s))] - s[lo + 1]) * (place - lo) ELSE 1.0 END AS q FROM (
     SELECT *, CAST(floor(place) AS BIGINT) AS lo FROM (
      SELECT z.*, f.scores, f.rate, list_sort(f.scores) AS s, (1 - f.rate) * (len(f.scores) - 1) AS place
      FROM f JOIN z ON z.symbol = f.symbol AND z.rn = f.rn + 1))))))
SELECT * FROM f WHERE rn > 0""")


@query("adaptive_conformal", "conf", "SELECT * FROM conf", keys="symbol covered", ints="pos set_size", floats="c_0 c_1 c_2 rate")
def adaptive_conformal(spark, sf):
    return clf.adaptive_conformal(models(spark, sf), FUSED, "label")


@query("conformal_position", "conf70", "SELECT *, c_2 - c_0 AS position FROM conf70", keys="symbol", ints="pos set_size", floats="rate position")
def conformal_position(spark, sf):
    """Sets learn on the leading 70 % and stay frozen after it."""
    m = flt.train_share(models(spark, sf), 0.7)
    out = clf.adaptive_conformal(m, FUSED, "label", learn="is_train")
    return out.withColumn("position", clf.conformal_position()).select("symbol", "pos", "set_size", "rate", "position")


@query("rule_strategy")
def rule_strategy(spark, sf):
    """Rule positions per path with the state carried in from the path's train rows."""
    f = feat.features_v1(td.bars(spark, sf))
    return rg.rule_strategy(folds.cpcv_split(f), S.FEATURES_V1)


@query("asset_state")
def asset_state(spark, sf):
    out = snap.asset_state(models(spark, sf))
    return out.select("symbol", "as_of", "current_close", F.col("current_regime.name").alias("regime"),
                      F.col("current_fusion.name").alias("fusion"), F.col("current_confidence.level").alias("confidence"),
                      F.col("model_consensus.level").alias("consensus"), F.col("transition_risk.level").alias("risk"),
                      F.size("history").alias("n_history"), F.array_join(F.col("transition_matrix")[0], ",").alias("bull_row"))


@query("write_asset_payload", "models", """
SELECT symbol, max(ts) AS as_of, arg_max(close, pos) AS current_close, arg_max(label, pos) AS label, translate(symbol, '=^/', '___') AS safe
FROM models GROUP BY symbol""", keys="symbol as_of safe", ints="label", floats="current_close")
def write_asset_payload(spark, sf):
    """Payloads through the JSON sink and back through its schema."""
    path = scratch(spark) + "/payloads"
    sinks.write_payloads(snap.asset_state(models(spark, sf)).select("symbol", "as_of", "current_close", "current_regime"), path)
    return sinks.read_payloads(spark, path, "symbol string, as_of date, current_close double, current_regime struct<label:int,name:string>, safe string").select(
        "symbol", "as_of", "current_close", F.col("current_regime.label").alias("label"), "safe")


cte("last_bar", "models", f"""
SELECT DATE '2001-12-01' AS generated_at, symbol, max(ts) AS as_of, arg_max(close, pos) AS close, arg_max(label, pos) AS label,
 CASE arg_max(label, pos) WHEN 0 THEN 'Bull' WHEN 1 THEN 'Neutral' ELSE 'Bear' END AS regime FROM models GROUP BY symbol""")


@query("snapshot_json", "last_bar", "SELECT * FROM last_bar", keys="generated_at symbol as_of regime", ints="label", floats="close")
def snapshot_json(spark, sf):
    """Payloads summarised, written as one JSON document per snapshot, read back and exploded."""
    path = scratch(spark) + "/documents"
    sinks.write_snapshot_json(snap.snapshot_summary(snap.asset_state(models(spark, sf)), F.lit("2001-12-01").cast("date")), path)
    return sinks.read_snapshot_json(spark, path)


@query("recent_history", "models", """
SELECT symbol, ts AS date, close, label FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pos DESC) AS rn FROM models) WHERE rn <= 252""",
       keys="symbol date", ints="label", floats="close")
def recent_history(spark, sf):
    """The last 252 bars out of nested payloads."""
    return snap.recent_history(snap.asset_state(models(spark, sf)))


@query("read_snapshot", "bars", "SELECT symbol, max(ts) AS as_of, arg_max(close, ts) AS close FROM bars GROUP BY 1", keys="symbol as_of", floats="close")
def read_snapshot(spark, sf):
    """Snapshot rows written by date, read back, newest date only per symbol."""
    path = scratch(spark) + "/snapshots"
    last = td.bars(spark, sf).groupBy("symbol").agg(F.max("ts").alias("as_of"), F.max_by("close", "ts").alias("close"))
    sinks.append_snapshot(last.withColumn("generated_at", F.lit("2001-12-01")), path)
    return spark.read.parquet(path)


@query("write_cache", "bars", "SELECT symbol, ts, close FROM bars WHERE symbol IN ('A', 'R') AND ts >= DATE '1997-01-01' AND ts < DATE '1999-01-01'",
       keys="symbol ts", floats="close")
def write_cache(spark, sf):
    """Cache by symbol, then a pruned and pushed-down read of two symbols and two years."""
    from ..sources.readers import read_closes
    path = scratch(spark) + "/cache"
    sinks.write_cache(td.bars(spark, sf).select("symbol", "ts", "close"), path)
    return read_closes(spark, path, ["A", "R"], "1997-01-01", "1999-01-01")


query("report_tables", "dist dsr pbo", """
SELECT d.strategy, d.symbol, d.n_paths, d.sharpe_p50, s.dsr_p_value, p.pbo,
 CASE WHEN p.pbo < 0.5 THEN 'generalises' WHEN p.pbo < 0.7 THEN 'borderline' ELSE 'severe overfitting' END AS pbo_verdict
FROM dist d JOIN dsr s ON d.strategy = s.strategy AND d.symbol = s.symbol JOIN pbo p ON d.symbol = p.symbol""",
      keys="strategy symbol pbo_verdict", ints="n_paths", floats="sharpe_p50 dsr_p_value pbo")(
    lambda spark, sf: snap.strategy_table(val.validate_many(frame(spark, sf), bt.benchmark_positions())))


@query("report_robustness", "s_eval", """
SELECT symbol, n_bars, sharpe_p50, CASE WHEN error IS NULL AND sharpe_p50 > 0 THEN '✓' WHEN error IS NULL AND sharpe_p50 IS NOT NULL THEN '✗' ELSE '—' END AS positive,
 CASE WHEN error IS NULL THEN '' ELSE 'FAILED: ' || error END AS notes FROM s_eval""", keys="symbol positive notes", ints="n_bars", floats="sharpe_p50")
def report_robustness(spark, sf):
    from .trading import evaluated
    return snap.robustness_table(evaluated(spark, sf))


# ---- streaming -----------------------------------------------------------------------------------

DAYS, YEARS = ["2024-01-11", "2024-01-21"], ["1998-01-01", "2000-01-01"]


@query("stream_daily_rv", "tick_day", "SELECT * FROM tick_day",
       keys="symbol day", ints="n", floats="rv rsv_pos rsv_neg")
def stream_daily_rv(spark, sf):
    r = intraday_returns(td.ticks(spark, sf)).select("symbol", "ts", "seq", "r")
    return live.replay(r, "ts", DAYS, live.daily_realised, flush=True)


@query("stream_bars", "ticks", """
SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(close, (ts, seq)) AS open, max(close) AS high, min(close) AS low,
 arg_max(close, (ts, seq)) AS close, count(*) AS volume FROM ticks GROUP BY 1, 2""",
       keys="symbol ts", ints="volume", floats="open high low close")
def stream_bars(spark, sf):
    return live.replay(td.ticks(spark, sf), "ts", DAYS, live.live_bars, flush=True)


@query("stream_sessions", "ticks", """
SELECT symbol, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n, min(close) AS low, max(close) AS high FROM (
 SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (
  SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY symbol ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM ticks))
GROUP BY symbol, session""", keys="symbol started ended", ints="n", floats="low high")
def stream_sessions(spark, sf):
    return live.replay(td.ticks(spark, sf), "ts", DAYS, live.tick_sessions, flush=True).withColumnsRenamed(
        {"start": "started", "end": "ended"})


@query("stream_regime_state", "rseq", "SELECT * FROM rseq", keys="symbol ts", ints="pos label", floats="p_0 p_1 p_2")
def stream_regime_state(spark, sf):
    return live.replay(rg.step_inputs(feat.features_v1(td.bars(spark, sf))), "ts", YEARS, live.regime_states)


@query("stream_conformal", "conf", "SELECT * FROM conf", keys="symbol", ints="pos set_size", floats="c_0 c_1 c_2 rate")
def stream_conformal(spark, sf):
    m = models(spark, sf).select("symbol", "pos", "ts", *[F.col(p).alias(n) for p, n in zip(FUSED, "abc")], F.col("label").alias("y"))
    return live.replay(m, "ts", YEARS, live.conformal_states)


@query("stream_changes", "rr", f"""
SELECT symbol, ts AS as_of, prev AS from_label, label AS to_label FROM (SELECT *, lag(label) OVER {W} AS prev FROM rr) WHERE prev <> label""",
       keys="symbol as_of", ints="from_label to_label")
def stream_changes(spark, sf):
    s = raw(spark, sf).select("symbol", F.col("ts").alias("as_of"), "label")
    return live.replay(s, "as_of", YEARS, live.label_changes)


@query("stream_drift", "psi", 'SELECT "column" AS feature, n_ref, n_cur, psi FROM psi', keys="feature", ints="n_ref n_cur", floats="psi")
def stream_drift(spark, sf):
    """Landed later line items against the stored edges of the earlier ones: counts per micro-batch, added up."""
    from .regime import PSI_COLS, drift_sides
    ref, cur = drift_sides(spark, sf)
    edges = stored(drift.reference_edges(ref, PSI_COLS))
    path = scratch(spark) + "/landing"
    cur.repartition(4).write.parquet(path)
    stream = live.read_stream(spark, cur, path, files_per_batch=1)
    return live.run_drift(stream, edges, PSI_COLS).withColumnRenamed("column", "feature")
