"""Regimes, diagnostics, consensus, alerts and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import frame as fr
from ..functions.columns import lookup
from ..functions.store import scratch, stored
from ..operators import alerts, consensus as cons, diagnostics as diag, drift
from ..operators import features as feat
from ..operators import labels as lab
from ..operators import regimes as rg
from ..sources import publication
from ..sources import readers as rd
from ..sources import testdata as td
from .base import query
from .sql import CTES, W, cte

P3 = "p_0 p_1 p_2"
_present = S.FEATURES_V1
W252 = "(PARTITION BY symbol ORDER BY pos ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"


def _norm(c: str) -> str:
    lo, hi = f"min({c}) OVER {W252}", f"max({c}) OVER {W252}"
    return (f"CASE WHEN count({c}) OVER {W252} >= 20 AND {hi} > {lo} THEN least(greatest(({c} - {lo}) / ({hi} - {lo}), 0), 1) "
            f"ELSE 0.5 END AS n_{c}")


def _score(k: int, present: list[str]) -> str:
    terms = []
    for c, w in zip(S.RULE_FEATURES, S.RULE_WEIGHTS[k]):
        x = f"n_{c}" if c in present else "0.5"
        if k == 2 and c in S.TAIL_GATED:
            x = f"least(greatest(({x} - 0.5) * 2, 0), 1)"
        terms.append(f"({w}::DOUBLE) * {x}")
    return " + ".join(terms)


def _rule(name: str, source: str, present: list[str]) -> None:
    cols = [c for c in S.RULE_FEATURES if c in present]
    cte(name, source, f"""
SELECT *, CASE WHEN raw_label <> 2 AND (abs(shock_z) > 3.5 OR abs(drawdown_252) > 0.15) THEN 2
  WHEN raw_label = 2 AND NOT (abs(shock_z) > 2.0 AND abs(drawdown_252) > 0.035) THEN CASE WHEN p_0 >= p_1 THEN 0 ELSE 1 END
  ELSE raw_label END AS label FROM (
 SELECT *, CASE WHEN p_0 >= p_1 AND p_0 >= p_2 THEN 0 WHEN p_1 >= p_2 THEN 1 ELSE 2 END AS raw_label FROM (
  SELECT *, e_0 / (e_0 + e_1 + e_2) AS p_0, e_1 / (e_0 + e_1 + e_2) AS p_1, e_2 / (e_0 + e_1 + e_2) AS p_2 FROM (
   SELECT *, exp(2.8 * (s_0 - greatest(s_0, s_1, s_2))) AS e_0, exp(2.8 * (s_1 - greatest(s_0, s_1, s_2))) AS e_1,
     exp(2.8 * (s_2 - greatest(s_0, s_1, s_2))) AS e_2 FROM (
    SELECT *, {', '.join(f'{_score(k, cols)} AS s_{k}' for k in range(3))} FROM (
     SELECT symbol, pos, ts, close, r, vol_ewma, vol_long, shock_z, drawdown_252, {', '.join(_norm(c) for c in cols)} FROM {source})))))""")


_rule("rr", "bars_f1", S.FEATURES_V1)
_rule("rr2", "f2", S.FEATURES_V2)
_rule("srr", "sbars_f1", S.FEATURES_V1)
cte("mapped", "rr", """
SELECT symbol, """ + ", ".join(
    f"sum(CASE WHEN label = {k} THEN {p} ELSE 0 END) / sum({p}) AS m_{s}_{k}"
    for s, p in enumerate(("(1 - n_vol_ewma)", "n_vol_ewma")) for k in range(3)) + " FROM rr GROUP BY symbol")
_lift = ", ".join(f"ln(p_{k} + 1e-9) + ln((1 - n_vol_ewma) * m_0_{k} + n_vol_ewma * m_1_{k} + 1e-9) AS l_{k}" for k in range(3))
cte("models", "rr mapped", f"""
SELECT *, -(fusion_p0 * ln(fusion_p0 + 1e-12) + fusion_p1 * ln(fusion_p1 + 1e-12) + fusion_p2 * ln(fusion_p2 + 1e-12)) / ln(3) AS entropy,
 CASE WHEN fusion_p0 >= fusion_p1 AND fusion_p0 >= fusion_p2 THEN 0 WHEN fusion_p1 >= fusion_p2 THEN 1 ELSE 2 END AS fusion_label,
 CASE WHEN greatest(p_low, p_high) < 0.6 THEN 1 WHEN p_low >= p_high THEN 0 ELSE 2 END AS vol_label FROM (
 SELECT *, x_0 / (x_0 + x_1 + x_2) AS fusion_p0, x_1 / (x_0 + x_1 + x_2) AS fusion_p1, x_2 / (x_0 + x_1 + x_2) AS fusion_p2 FROM (
  SELECT *, exp(l_0 - greatest(l_0, l_1, l_2)) AS x_0, exp(l_1 - greatest(l_0, l_1, l_2)) AS x_1, exp(l_2 - greatest(l_0, l_1, l_2)) AS x_2 FROM (
   SELECT rr.*, 1 - n_vol_ewma AS p_low, n_vol_ewma AS p_high,
    CASE WHEN n_vol_long < 1.0 / 3 THEN 0 WHEN n_vol_long < 2.0 / 3 THEN 1 ELSE 2 END AS gmm_label, {_lift}
   FROM rr JOIN mapped m ON rr.symbol = m.symbol)))""")


def raw(spark, sf, by="flag"):
    return rg.raw_regimes(feat.features_v1(td.bars(spark, sf, by)))


def models(spark, sf):
    """Rule labels, a volatility-state model, a volatility-tercile model and their fusion, per bar, stored once."""
    df = feat.minmax_normalise(raw(spark, sf), {"_vl": "vol_long"})
    gmm = F.when(F.col("_vl") < 1.0 / 3, 0).when(F.col("_vl") < 2.0 / 3, 1).otherwise(2)
    df = df.select("symbol", "pos", "ts", "close", "r", "p_0", "p_1", "p_2", "label", (1 - F.col("vol_n")).alias("p_low"),
                   F.col("vol_n").alias("p_high"), gmm.alias("gmm_label"))
    df = stored(df)
    return stored(rg.fuse(df, rg.state_mapping(df)).withColumn("vol_label", rg.vol_state_class("p_low", "p_high")))


BAR = dict(keys="symbol", ints="pos")

query("rule_scores", "rr", "SELECT * FROM rr", **BAR, floats="s_0 s_1 s_2")(
    lambda spark, sf: rg.rule_scores(feat.features_v1(td.bars(spark, sf))))
query("rule_scores_v2", "rr2", "SELECT * FROM rr2", keys="symbol", ints="pos label", floats="s_0 s_1 s_2 p_0 p_1 p_2")(
    lambda spark, sf: rg.raw_regimes(feat.features_v2(td.bars(spark, sf), feat.aux_bundle(td.aux(spark, sf)),
                                                      td.bars(spark, sf).select("symbol", "pos", "ts", "open", "high", "low", "close"))))
query("softmax", "rr", "SELECT * FROM rr", **BAR, floats=P3)(raw)
query("argmax_label", "rr", "SELECT * FROM rr", keys="symbol", ints="pos raw_label")(raw)
query("risk_confirm", "rr", "SELECT * FROM rr", keys="symbol", ints="pos raw_label label")(raw)


# the stabilised rule, bar by bar: state is the label, its age, the last raw label and the last volatility rank
cte("rseq", "rr", f"""
WITH RECURSIVE z AS (SELECT symbol, pos, ts, row_number() OVER {W} AS rn, s_0, s_1, s_2, n_vol_ewma AS v, abs(coalesce(shock_z, 0)) AS sh,
 abs(coalesce(drawdown_252, 0)) AS dd FROM rr),
f AS (SELECT DISTINCT symbol, -1::BIGINT AS pos, NULL::DATE AS ts, 0::BIGINT AS rn, NULL::INT AS cur, 0 AS age, NULL::INT AS raw, NULL::DOUBLE AS vol, 0::DOUBLE AS p_0, 0::DOUBLE AS p_1, 0::DOUBLE AS p_2 FROM z
 UNION ALL
 SELECT symbol, pos, ts, rn, CASE WHEN moved THEN wanted ELSE cur END, CASE WHEN moved THEN 1 ELSE age + 1 END, raw, v, p_0, p_1, p_2 FROM (
  SELECT *, cur IS NULL OR (wanted <> cur AND (CASE wanted WHEN 0 THEN p_0 WHEN 1 THEN p_1 ELSE p_2 END) - (CASE cur WHEN 0 THEN p_0 WHEN 1 THEN p_1 ELSE p_2 END) > 0.04 AND age >= 1) AS moved FROM (
   SELECT *, coalesce(last_raw, raw) AS wanted FROM (
    SELECT *, CASE WHEN top <> 2 AND (sh > 3.5 OR dd > 0.15) THEN 2 WHEN top = 2 AND NOT (sh > 2.0 AND dd > 0.035) THEN CASE WHEN p_0 >= p_1 THEN 0 ELSE 1 END ELSE top END AS raw FROM (
     SELECT *, CASE WHEN p_0 >= p_1 AND p_0 >= p_2 THEN 0 WHEN p_1 >= p_2 THEN 1 ELSE 2 END AS top FROM (
      SELECT *, e_0 / (e_0 + e_1 + e_2) AS p_0, e_1 / (e_0 + e_1 + e_2) AS p_1, e_2 / (e_0 + e_1 + e_2) AS p_2 FROM (
       SELECT *, exp((c_0 - greatest(c_0, c_1, c_2)) * 2.8) AS e_0, exp((c_1 - greatest(c_0, c_1, c_2)) * 2.8) AS e_1, exp((c_2 - greatest(c_0, c_1, c_2)) * 2.8) AS e_2 FROM (
        SELECT * REPLACE (CASE WHEN cur = 1 AND age > 30 AND v > vol THEN least(c_1, greatest(c_0, c_2) - 0.01) ELSE c_1 END AS c_1) FROM (
         SELECT z.*, f.cur, f.age, f.raw AS last_raw, f.vol, z.s_0 * CASE WHEN f.cur = 0 AND f.age > 60 THEN 0.8 ELSE 1 END AS c_0,
          z.s_1 * CASE WHEN f.cur = 1 AND f.age > 60 THEN 0.8 ELSE 1 END AS c_1, z.s_2 * CASE WHEN f.cur = 2 AND f.age > 60 THEN 0.8 ELSE 1 END AS c_2
         FROM f JOIN z ON z.symbol = f.symbol AND z.rn = f.rn + 1)))))))))
SELECT symbol, pos, ts, cur AS label, p_0, p_1, p_2, CASE cur WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE -0.5 END AS position,
 CASE cur WHEN 0 THEN 'Bull' WHEN 1 THEN 'Neutral' ELSE 'Bear' END AS regime FROM f WHERE rn > 0""")
SEQ = dict(keys="symbol ts regime", ints="pos label", floats="p_0 p_1 p_2 position")


@query("rule_regime_sequence", "rseq", "SELECT * FROM rseq", **SEQ)
def rule_regime_sequence(spark, sf):
    """Stabilised labels with over-extension penalty: a recursion, tested against a plain loop."""
    return rg.rule_sequence(feat.features_v1(td.bars(spark, sf)))


@query("stabilise", "rseq rr", """
SELECT q.symbol, count(*) AS n_bars, count(*) FILTER (WHERE q.label <> rr.label) AS n_held FROM rseq q JOIN rr ON q.symbol = rr.symbol AND q.pos = rr.pos GROUP BY 1""",
       keys="symbol", ints="n_bars n_held")
def stabilise(spark, sf):
    """Bars where the stabilised label differs from the memoryless one."""
    f = feat.features_v1(td.bars(spark, sf))
    base = rg.raw_regimes(f).select("symbol", "pos", F.col("label").alias("memoryless"))
    return rg.rule_sequence(f).join(base, ["symbol", "pos"]).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_bars"), F.count_if(F.col("label") != F.col("memoryless")).alias("n_held"))


@query("overextension_adjust", "rseq", f"""
SELECT symbol, label, max(n) AS longest, count(*) AS n_runs FROM (
 SELECT symbol, label, count(*) AS n FROM (
  SELECT *, row_number() OVER {W} - row_number() OVER (PARTITION BY symbol, label ORDER BY pos) AS island FROM rseq) GROUP BY symbol, label, island) GROUP BY 1, 2""",
       keys="symbol", ints="label longest n_runs")
def overextension_adjust(spark, sf):
    """Longest streak per regime under the over-extension penalty."""
    r = fr.runs(rg.rule_sequence(feat.features_v1(td.bars(spark, sf))))
    return r.groupBy("symbol", "label").agg(F.max("run_len").alias("longest"), F.count(F.lit(1)).alias("n_runs"))


query("confirmed_label", "models", """
SELECT *, CASE WHEN own >= 0.25 OR NOT (best > 0.55) THEN label ELSE idx END AS confirmed FROM (
 SELECT *, CASE label WHEN 0 THEN p_0 WHEN 1 THEN p_1 ELSE p_2 END AS own,
  CASE label WHEN 0 THEN greatest(p_1, p_2) WHEN 1 THEN greatest(p_0, p_2) ELSE greatest(p_0, p_1) END AS best,
  CASE label WHEN 0 THEN CASE WHEN p_1 >= p_2 THEN 1 ELSE 2 END WHEN 1 THEN CASE WHEN p_0 >= p_2 THEN 0 ELSE 2 END
   ELSE CASE WHEN p_0 >= p_1 THEN 0 ELSE 1 END END AS idx
 FROM (SELECT symbol, pos, label, fusion_p0 AS p_0, fusion_p1 AS p_1, fusion_p2 AS p_2 FROM models))""",
      keys="symbol", ints="pos label confirmed")(
    lambda spark, sf: models(spark, sf).withColumn("confirmed", rg.confirmed_label(
        "label", ["fusion_p0", "fusion_p1", "fusion_p2"])))
query("vol_state_to_class", "models", "SELECT * FROM models", keys="symbol", ints="pos vol_label", floats="p_low p_high")(models)
query("regime_entropy", "models", "SELECT * FROM models", **BAR, floats="entropy")(models)
query("log_opinion_pool", "models", "SELECT * FROM models", keys="symbol", ints="pos fusion_label",
      floats="fusion_p0 fusion_p1 fusion_p2")(models)
MAP = " ".join(f"m_{s}_{k}" for s in range(2) for k in range(3))
query("empirical_state_mapping", "mapped", "SELECT * FROM mapped", keys="symbol", floats=MAP)(
    lambda spark, sf: rg.state_mapping(raw(spark, sf).withColumns({"p_high": F.col("vol_n"), "p_low": 1 - F.col("vol_n")})))

_nm = "CASE {} WHEN 0 THEN 'Bull' WHEN 1 THEN 'Neutral' ELSE 'Bear' END"
cte("ranked2", "models", """
SELECT symbol, pos, max(CASE WHEN rn = 1 THEN p END) AS p1, max(CASE WHEN rn = 1 THEN i END) AS i1, max(CASE WHEN rn = 2 THEN p END) AS p2,
 max(CASE WHEN rn = 2 THEN i END) AS i2 FROM (
 SELECT symbol, pos, p, i, row_number() OVER (PARTITION BY symbol, pos ORDER BY p DESC, i) AS rn FROM (
  SELECT symbol, pos, fusion_p0 AS p, 0 AS i FROM models UNION ALL SELECT symbol, pos, fusion_p1, 1 FROM models
  UNION ALL SELECT symbol, pos, fusion_p2, 2 FROM models)) GROUP BY 1, 2""")
FUSED = ["fusion_p0", "fusion_p1", "fusion_p2"]


@query("confidence_class", "models ranked2", f"""
SELECT r.symbol, r.pos, CASE WHEN p1 > 0.65 AND p2 < 0.25 THEN 'high' WHEN p1 > 0.5 THEN 'medium' ELSE 'low' END AS confidence,
 least(greatest(1 - m.entropy, 0), 1) AS confidence_score, p1 - p2 AS margin, {_nm.format('i1')} AS top_regime, {_nm.format('i2')} AS second_regime
FROM ranked2 r JOIN models m ON r.symbol = m.symbol AND r.pos = m.pos""", keys="symbol confidence top_regime second_regime",
       ints="pos", floats="confidence_score margin")
def confidence_class(spark, sf):
    return rg.confidence(models(spark, sf), FUSED)


query("model_consensus", "models", """
SELECT symbol, pos, n AS agreement_count, n / 3.0 AS agreement_pct, CASE n WHEN 3 THEN 'unanimous' WHEN 2 THEN 'strong' WHEN 1 THEN 'split' ELSE 'divided' END AS consensus_level,
 concat_ws(',', CASE WHEN label <> fusion_label THEN 'rule' END, CASE WHEN gmm_label <> fusion_label THEN 'gmm' END, CASE WHEN vol_label <> fusion_label THEN 'tvtp' END) AS dissenters
FROM (SELECT *, (label = fusion_label)::INT + (gmm_label = fusion_label)::INT + (vol_label = fusion_label)::INT AS n FROM models)""",
      keys="symbol consensus_level dissenters", ints="pos agreement_count", floats="agreement_pct")(
    lambda spark, sf: rg.model_consensus(models(spark, sf), {"rule": "label", "gmm": "gmm_label", "tvtp": "vol_label"}, "fusion_label")
    .withColumn("dissenters", F.array_join("dissenters", ",")))

cte("margins", "ranked2", f"""
SELECT symbol, pos, now AS margin_now, past AS margin_lookback, CASE WHEN past IS NULL THEN NULL WHEN past <= 1e-9 THEN 0 ELSE 1 - now / past END AS compression
FROM (SELECT symbol, pos, p1 - p2 AS now, lag(p1 - p2, 5) OVER {W} AS past FROM ranked2)""")
query("margin_compression", "margins", "SELECT *, coalesce(least(greatest(compression, 0), 1), 0) AS margin_score FROM margins", **BAR,
      floats="margin_now margin_lookback compression margin_score")(
    lambda spark, sf: rg.margin_compression(models(spark, sf), FUSED))
cte("accel", "models ranked2", f"""
SELECT symbol, pos, second_regime, second_prob, second_prob - CASE second_regime WHEN 0 THEN l0 WHEN 1 THEN l1 ELSE l2 END AS second_delta FROM (
 SELECT m.symbol, m.pos, r.i2 AS second_regime, r.p2 AS second_prob, lag(fusion_p0, 5) OVER (PARTITION BY m.symbol ORDER BY m.pos) AS l0,
  lag(fusion_p1, 5) OVER (PARTITION BY m.symbol ORDER BY m.pos) AS l1, lag(fusion_p2, 5) OVER (PARTITION BY m.symbol ORDER BY m.pos) AS l2
 FROM models m JOIN ranked2 r ON m.symbol = r.symbol AND m.pos = r.pos)""")
query("second_prob_acceleration", "accel", """
SELECT *, coalesce(least(greatest(second_delta / 0.2, 0), 1), 0) AS accel_score FROM accel""", keys="symbol", ints="pos second_regime",
      floats="second_prob second_delta accel_score")(lambda spark, sf: rg.runner_up_acceleration(models(spark, sf), FUSED))

# runs of a label, reused by persistence, stability, durations and bands
cte("runs", "rr", """
SELECT symbol, run_id, any_value(label) AS label, min(pos) AS run_start, max(pos) AS run_end, count(*) AS run_len, min(ts) AS ts_start,
 max(ts) AS ts_end, run_id < max(run_id) OVER (PARTITION BY symbol) AS completed FROM (
 SELECT *, sum(chg) OVER (PARTITION BY symbol ORDER BY pos) AS run_id FROM (
  SELECT symbol, pos, ts, label, CASE WHEN label = lag(label) OVER (PARTITION BY symbol ORDER BY pos) THEN 0 ELSE 1 END AS chg FROM rr))
GROUP BY symbol, run_id""")
query("state_durations", "runs", "SELECT * FROM runs", keys="symbol completed", ints="label run_start run_end run_len")(
    lambda spark, sf: fr.runs(raw(spark, sf)))
cte("persist", "runs", """
SELECT *, CASE WHEN n_past = 0 THEN 0 WHEN streak <= median_len THEN 0 WHEN streak <= p75_len THEN least(greatest(0.3 * (streak - median_len) / greatest(p75_len - median_len, 1), 0), 1)
 ELSE least(1, 0.3 + 0.7 * (streak - p75_len) / greatest(p75_len, 1)) END AS persist_score,
 coalesce(greatest(0, round_even(median_len - streak, 0)), 0) AS expected_remaining FROM (
 SELECT c.symbol, c.label, c.run_len AS streak, count(h.run_len) AS n_past, quantile_cont(h.run_len, 0.5) AS median_len,
  quantile_cont(h.run_len, 0.75) AS p75_len, coalesce(avg(CASE WHEN h.run_len <= c.run_len THEN 1.0 WHEN h.run_len IS NOT NULL THEN 0.0 END), 0) AS percentile
 FROM runs c LEFT JOIN runs h ON c.symbol = h.symbol AND c.label = h.label AND h.completed WHERE NOT c.completed GROUP BY 1, 2, 3)""")
query("regime_persistence", "persist", "SELECT * FROM persist", keys="symbol", ints="label streak n_past expected_remaining",
      floats="median_len p75_len percentile persist_score")(lambda spark, sf: rg.regime_persistence(raw(spark, sf)))
query("transition_risk", "persist margins accel", """
SELECT *, CASE WHEN risk_score >= 0.5 THEN 'high' WHEN risk_score >= 0.3 THEN 'medium' ELSE 'low' END AS risk_level FROM (
 SELECT p.symbol, p.label, p.streak, m.compression, a.second_delta, p.persist_score,
  least(greatest(0.4 * coalesce(least(greatest(m.compression, 0), 1), 0) + 0.3 * p.persist_score + 0.3 * coalesce(least(greatest(a.second_delta / 0.2, 0), 1), 0), 0), 1) AS risk_score
 FROM persist p JOIN margins m ON p.symbol = m.symbol JOIN accel a ON m.symbol = a.symbol AND m.pos = a.pos
 WHERE m.pos = (SELECT max(pos) FROM margins x WHERE x.symbol = m.symbol))""", keys="symbol risk_level", ints="label streak",
      floats="compression second_delta persist_score risk_score")(lambda spark, sf: rg.transition_risk(models(spark, sf), FUSED))

# ---- diagnostics ---------------------------------------------------------------------------------

cte("monthly", "", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') * 3 > count(*) THEN 1 ELSE 0 END AS flag
FROM orders GROUP BY 1""")
cte("flagged", "rr monthly", """
SELECT *, coalesce(last_value(seen IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS flag FROM (
 SELECT rr.symbol, rr.pos, rr.ts, (rr.label = 2)::INT AS bear, CASE WHEN isodow(rr.ts) < 6 AND rr.ts <= (SELECT max(month) FROM monthly) THEN m.flag END AS seen
 FROM rr LEFT JOIN monthly m ON date_trunc('month', rr.ts) = m.month)""")
cte("episodes", "flagged", """
SELECT symbol, run, any_value(flag) AS flag, min(ts) AS start, min(CASE WHEN bear = 1 THEN ts END) AS hit, arg_min(bear, pos) AS first_bear FROM (
 SELECT *, sum(chg) OVER (PARTITION BY symbol ORDER BY pos) AS run FROM (
  SELECT *, CASE WHEN flag = lag(flag) OVER (PARTITION BY symbol ORDER BY pos) THEN 0 ELSE 1 END AS chg FROM flagged)) GROUP BY 1, 2""")
query("recession_alignment", "flagged episodes", """
SELECT c.symbol, n_bear_bars, n_recession_bars, n_overlap, round(p, 4) AS precision, round(r, 4) AS recall,
 round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1, CAST(floor(l.med) AS BIGINT) AS median_days_to_bear FROM (
 SELECT *, CASE WHEN n_bear_bars > 0 THEN n_overlap / n_bear_bars ELSE 0 END AS p, CASE WHEN n_recession_bars > 0 THEN n_overlap / n_recession_bars ELSE 0 END AS r FROM (
  SELECT symbol, sum(bear) AS n_bear_bars, sum(flag) AS n_recession_bars, sum(bear * flag) AS n_overlap FROM flagged GROUP BY 1)) c
LEFT JOIN (SELECT symbol, median(date_diff('day', start, coalesce(hit, CASE WHEN end_bear = 1 THEN nxt END))) AS med FROM (
  SELECT *, lead(start) OVER (PARTITION BY symbol ORDER BY run) AS nxt, lead(first_bear) OVER (PARTITION BY symbol ORDER BY run) AS end_bear FROM episodes)
 WHERE flag = 1 AND nxt IS NOT NULL GROUP BY 1) l ON c.symbol = l.symbol""", keys="symbol",
      ints="n_bear_bars n_recession_bars n_overlap median_days_to_bear", floats="precision recall f1")(
    lambda spark, sf: diag.recession_alignment(raw(spark, sf).select("symbol", "pos", "ts", "label"), td.recession_flag(spark, sf)))
_bin = " + ".join(f"(p >= {e!r}::DOUBLE)::INT" for e in diag.BIN_EDGES)
cte("bins", "models", f"""
SELECT symbol, class, bin, count(*) AS n, avg(p) AS confidence, avg(y) AS accuracy FROM (
 SELECT symbol, class, p, y, {_bin} AS bin FROM (
  SELECT symbol, 0 AS class, fusion_p0 AS p, (label = 0)::INT AS y FROM models UNION ALL
  SELECT symbol, 1, fusion_p1, (label = 1)::INT FROM models UNION ALL SELECT symbol, 2, fusion_p2, (label = 2)::INT FROM models)) GROUP BY 1, 2, 3""")
query("reliability_bins", "bins", "SELECT * FROM bins", keys="symbol", ints="class bin n", floats="confidence accuracy")(
    lambda spark, sf: diag.reliability_bins(models(spark, sf), FUSED))
query("calibration_error", "bins", """
SELECT symbol, class, sum(n) AS n, round(sum(n * abs(confidence - accuracy)) / sum(n), 4) AS ece FROM bins GROUP BY 1, 2""",
      keys="symbol", ints="class n", floats="ece")(
    lambda spark, sf: diag.calibration_error(diag.reliability_bins(models(spark, sf), FUSED)))
query("regime_stability", "runs", """
SELECT symbol, label, round(mean, 2) AS mean_duration, median_duration, n_episodes, round(bars / n_bars, 4) AS pct_time, round((k - 1) / (n_bars - 1), 4) AS flip_rate,
 first_value(label) OVER (PARTITION BY symbol ORDER BY round(mean, 2) DESC, label) AS dominant_regime FROM (
 SELECT *, sum(bars) OVER (PARTITION BY symbol) AS n_bars, sum(n_episodes) OVER (PARTITION BY symbol) AS k FROM (
  SELECT symbol, label, avg(run_len) AS mean, median(run_len) AS median_duration, count(*) AS n_episodes, sum(run_len) AS bars FROM runs GROUP BY 1, 2))""",
      keys="symbol", ints="label n_episodes dominant_regime", floats="mean_duration median_duration pct_time flip_rate")(
    lambda spark, sf: diag.regime_stability(raw(spark, sf)))
_ck = "(SELECT symbol, count(*) AS n, avg((label = gmm_label)::INT) AS po, " + ", ".join(
    f"avg((label = {k})::INT) * avg((gmm_label = {k})::INT) AS e{k}" for k in range(3)) + " FROM models GROUP BY symbol)"
query("cohen_kappa", "models", f"SELECT symbol, n, (po - (e0 + e1 + e2)) / (1 - (e0 + e1 + e2)) AS kappa FROM {_ck}", keys="symbol", ints="n",
      floats="kappa")(lambda spark, sf: diag.cohen_kappa(models(spark, sf), "label", "gmm_label"))
_cells = [f"c_{i}{j}" for i in range(3) for j in range(3)]
query("cross_model_concordance", "models", f"""
SELECT m.*, round(k.kappa, 4) AS kappa FROM (
 SELECT symbol, count(*) AS n_aligned, round(avg((label = gmm_label)::INT), 4) AS first_second, round(avg(((label = 2) = (t = 2))::INT), 4) AS first_third,
  round(avg(((gmm_label = 2) = (t = 2))::INT), 4) AS second_third, round(avg((label = gmm_label OR label = t OR gmm_label = t)::INT), 4) AS consensus_score,
  {', '.join(f"count(*) FILTER (WHERE label = {c[2]} AND gmm_label = {c[3]}) AS {c}" for c in _cells)}
 FROM (SELECT *, CASE WHEN p_high > 0.5 THEN 2 ELSE 0 END AS t FROM models) GROUP BY 1) m
JOIN (SELECT symbol, (po - (e0 + e1 + e2)) / (1 - (e0 + e1 + e2)) AS kappa FROM {_ck}) k ON m.symbol = k.symbol""",
      keys="symbol", ints="n_aligned " + " ".join(_cells), floats="first_second first_third second_third consensus_score kappa")(
    lambda spark, sf: diag.concordance(models(spark, sf), "label", "gmm_label", "p_high"))
query("transition_matrix", "rr", """
SELECT s.symbol, s.a AS from_state, s.b AS to_state, coalesce(n, 0) AS n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY s.symbol, s.a), 0), 0), 4) AS probability FROM (
 SELECT symbol, a.range AS a, b.range AS b FROM (SELECT DISTINCT symbol FROM rr) CROSS JOIN range(3) a CROSS JOIN range(3) b) s LEFT JOIN (
 SELECT symbol, prev, label, count(*) AS n FROM (SELECT symbol, label, lag(label) OVER (PARTITION BY symbol ORDER BY pos) AS prev FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pos DESC) AS rn FROM rr) WHERE rn <= 756) WHERE prev IS NOT NULL GROUP BY 1, 2, 3) c
ON s.symbol = c.symbol AND s.a = c.prev AND s.b = c.label""", keys="symbol", ints="from_state to_state n", floats="probability")(
    lambda spark, sf: diag.transition_matrix(raw(spark, sf)))
query("regime_bands", "runs", """
SELECT symbol, ts_start AS band_start, coalesce(lead(ts_start) OVER (PARTITION BY symbol ORDER BY run_id), ts_end) AS band_end, label FROM runs""",
      keys="symbol band_start band_end", ints="label")(lambda spark, sf: diag.regime_bands(raw(spark, sf)))


@query("diagnostics_report")
def diagnostics_report(spark, sf):
    """Stability, agreement, calibration and alignment as one long metric table."""
    from ..plans.snapshot import diagnostics_report as report
    return report(models(spark, sf), td.recession_flag(spark, sf), FUSED)


_tgt = """SELECT symbol, pos, p_2, CASE WHEN n = 5 AND (lo <> label OR hi <> label) THEN 1 ELSE 0 END AS target, n = 5 AS in_fit,
 CASE WHEN fusion_p1 > 0.4 THEN 1 ELSE 0 END AS predicted FROM (SELECT *, count(label) OVER w AS n, min(label) OVER w AS lo, max(label) OVER w AS hi FROM models
 WINDOW w AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))"""
query("detector_metrics", "models", f"""
SELECT symbol, n_positive, n_predicted, pr AS precision, rc AS recall, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1,
 CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END >= 0.4 AND pr >= 0.4 AS passes_gate FROM (
 SELECT symbol, sum(target) AS n_positive, sum(predicted) AS n_predicted, coalesce(sum(target * predicted) / nullif(sum(predicted), 0), 0) AS pr,
  coalesce(sum(target * predicted) / nullif(sum(target), 0), 0) AS rc FROM ({_tgt}) WHERE in_fit GROUP BY 1)""",
      keys="symbol passes_gate", ints="n_positive n_predicted", floats="precision recall f1")(
    lambda spark, sf: diag.detector_metrics(lab.transition_target(models(spark, sf)).withColumn(
        "predicted", F.when(F.col("fusion_p1") > 0.4, 1).otherwise(0)), "predicted", "target"))
query("transition_gate", "models", """
SELECT symbol, pos, position * least(greatest(1 - fusion_p1, 0), 1) AS smooth, position * (fusion_p1 <= 0.7)::INT AS hard FROM (
 SELECT *, CASE label WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE -0.5 END AS position FROM models)""", **BAR, floats="smooth hard")(
    lambda spark, sf: models(spark, sf).withColumn("position", lookup("label", S.REGIME_ALLOC)).withColumns({
        "smooth": rg.gated_position("position", "fusion_p1"), "hard": rg.gated_position("position", "fusion_p1", smooth=False)}))


# ---- consensus, changes, alerts ------------------------------------------------------------------

cte("votes", "models", """
SELECT ts AS generated_at, symbol, CASE WHEN entropy < 0.999 THEN fusion_label ELSE label END AS vote, label,
 CASE WHEN entropy < 0.999 THEN greatest(fusion_p0, fusion_p1, fusion_p2) ELSE greatest(p_0, p_1, p_2) END AS top_prob,
 least(greatest(1 - entropy, 0), 1) AS confidence_score FROM models""")
cte("consensus", "votes", """
SELECT *, CASE regime_label WHEN 0 THEN 'Bull' WHEN 1 THEN 'Neutral' WHEN 2 THEN 'Bear' END AS regime, agreement_count / n_assets AS agreement_pct,
 CASE WHEN agreement_count / n_assets >= 0.8 THEN 'strong' WHEN agreement_count / n_assets >= 0.6 THEN 'moderate' WHEN agreement_count / n_assets >= 0.4 THEN 'split' ELSE 'divided' END AS level FROM (
 SELECT generated_at, max(CASE WHEN rn = 1 THEN vote END) AS regime_label, max(CASE WHEN rn = 1 THEN n END) AS agreement_count, sum(n) AS n_assets,
  max(CASE WHEN rn = 1 THEN score END) AS mean_confidence, coalesce(sum(CASE WHEN vote = 0 THEN n END), 0) AS n_bull,
  coalesce(sum(CASE WHEN vote = 1 THEN n END), 0) AS n_neutral, coalesce(sum(CASE WHEN vote = 2 THEN n END), 0) AS n_bear, 0 AS n_failed FROM (
  SELECT *, row_number() OVER (PARTITION BY generated_at ORDER BY n DESC, sure DESC, first) AS rn FROM (
   SELECT generated_at, vote, count(*) AS n, sum(top_prob) AS sure, min(symbol) AS first, avg(confidence_score) AS score FROM votes GROUP BY 1, 2)) GROUP BY 1)""")


def votes(spark, sf):
    """Snapshot rows: fused output counts as missing where the pooled posterior is near uniform."""
    m = models(spark, sf)
    sure = F.col("entropy") < 0.999
    m = rg.confidence(m, FUSED).withColumns({c: F.when(sure, F.col(c)) for c in ["fusion_label", *FUSED]})
    return cons.asset_vote(m.withColumnRenamed("ts", "generated_at"))


query("asset_vote", "votes", "SELECT * FROM votes", keys="generated_at symbol", ints="vote", floats="top_prob")(votes)
CONS = dict(keys="generated_at regime level", ints="regime_label agreement_count n_assets n_failed n_bull n_neutral n_bear",
            floats="agreement_pct mean_confidence")
query("market_consensus", "consensus", "SELECT * FROM consensus", **CONS)(
    lambda spark, sf: cons.market_consensus(votes(spark, sf)))
query("consensus_voters", "votes consensus", """
SELECT v.generated_at, v.symbol, v.vote, v.vote = c.regime_label AS agrees FROM votes v JOIN consensus c ON v.generated_at = c.generated_at""",
      keys="generated_at symbol agrees", ints="vote")(
    lambda spark, sf: cons.voters(votes(spark, sf), cons.market_consensus(votes(spark, sf))))

# monthly snapshots: the last bar of each month per symbol
cte("snaps", "rr", """
SELECT CAST(date_trunc('month', ts) AS DATE) AS generated_at, symbol, arg_max(label, pos) AS label FROM rr GROUP BY 1, 2""")
cte("snap_rank", "snaps", "SELECT *, dense_rank() OVER (ORDER BY generated_at DESC) AS rk FROM snaps")
cte("compared", "snap_rank", f"""
SELECT c.symbol, c.generated_at AS curr_date, p.generated_at AS prev_date, p.label AS from_label, c.label AS to_label,
 {_nm.format('p.label')} AS from_regime, {_nm.format('c.label')} AS to_regime FROM snap_rank c JOIN snap_rank p ON c.symbol = p.symbol AND c.rk = 1 AND p.rk = 2""")


def snapshots(spark, sf, by="flag"):
    return raw(spark, sf, by).groupBy(F.trunc("ts", "month").alias("generated_at"), "symbol").agg(
        F.max_by("label", "pos").alias("label"))


query("rotate_snapshot", "snap_rank", "SELECT * FROM snap_rank WHERE rk = 2", keys="generated_at symbol", ints="label")(
    lambda spark, sf: cons.previous_snapshot(snapshots(spark, sf)))
for _n, _deps in (("snaps", "srr"), ("snap_rank", "s_snaps"), ("compared", "s_snap_rank")):  # a symbol per supplier
    cte(f"s_{_n}", _deps, CTES[_n][1].replace("FROM rr", "FROM srr").replace("FROM snap", "FROM s_snap").replace("JOIN snap", "JOIN s_snap"))


@query("publish_snapshot", "snap_rank", """
SELECT CASE rk WHEN 1 THEN 'current' ELSE 'previous' END AS which, generated_at, symbol, label FROM snap_rank WHERE rk <= 2""",
       keys="which generated_at symbol", ints="label")
def publish_snapshot(spark, sf):
    """The two newest snapshots published in turn; a third whose coverage is too low leaves them as they are."""
    path = scratch(spark)
    rows = stored(cons.latest_snapshots(snapshots(spark, sf)))
    universe = rows.select("symbol").distinct()
    for rank in (2, 1):
        one = rows.where(F.col("snapshot_rank") == rank)
        day = one.agg(F.max("generated_at").cast("string")).first()[0]
        publication.publish(one.select("symbol", "label"), rd.coverage_gate(universe, one), path, day)
    publication.publish(rows.select("symbol", "label").limit(0), rd.coverage_gate(universe, rows.limit(0)), path, "9999-12-31")
    return (publication.published(spark, path, "symbol string, label int").withColumn("which", F.lit("current")).unionByName(
        publication.published(spark, path, "symbol string, label int", "previous").withColumn("which", F.lit("previous"))))


query("asset_changes", "s_compared", "SELECT * FROM s_compared WHERE from_label <> to_label", keys="symbol curr_date prev_date from_regime to_regime",
      ints="from_label to_label")(lambda spark, sf: cons.asset_changes(stored(snapshots(spark, sf, "supplier"))))
cte("cons_change", "consensus", """
SELECT * FROM (SELECT generated_at, regime AS to_regime, level AS to_level, lag(regime) OVER (ORDER BY generated_at) AS from_regime,
 lag(level) OVER (ORDER BY generated_at) AS from_level, lag(generated_at) OVER (ORDER BY generated_at) AS prev_date FROM consensus)
WHERE prev_date IS NOT NULL AND (to_regime IS DISTINCT FROM from_regime OR to_level IS DISTINCT FROM from_level)""")
query("consensus_change", "cons_change", "SELECT * FROM cons_change", keys="generated_at prev_date from_regime from_level to_regime to_level")(
    lambda spark, sf: cons.consensus_change(cons.market_consensus(votes(spark, sf))))
cte("snap_cons", "snaps", """
SELECT *, CASE WHEN n * 1.0 / total >= 0.8 THEN 'strong' WHEN n * 1.0 / total >= 0.6 THEN 'moderate' WHEN n * 1.0 / total >= 0.4 THEN 'split' ELSE 'divided' END AS level FROM (
 SELECT *, row_number() OVER (PARTITION BY generated_at ORDER BY n DESC, first) AS rn, sum(n) OVER (PARTITION BY generated_at) AS total FROM (
  SELECT generated_at, label, count(*) AS n, min(symbol) AS first FROM snaps GROUP BY 1, 2)) WHERE rn = 1""")
cte("report", "compared snap_cons", """
SELECT x.*, k.changed AS consensus_changed, n_changed > 0 OR k.changed AS has_changes FROM (
 SELECT prev_date, curr_date, count(*) FILTER (WHERE from_label <> to_label) AS n_changed, count(*) FILTER (WHERE from_label = to_label) AS n_unchanged FROM compared GROUP BY 1, 2) x
JOIN (SELECT generated_at, (label IS DISTINCT FROM lag(label) OVER (ORDER BY generated_at)) OR (level IS DISTINCT FROM lag(level) OVER (ORDER BY generated_at)) AS changed FROM snap_cons) k
ON x.curr_date = k.generated_at""")


def snapshot_consensus(spark, sf):
    s = snapshots(spark, sf).withColumns({"vote": F.col("label"), "top_prob": F.lit(0.0), "confidence_score": F.lit(None).cast("double")})
    return cons.market_consensus(s)


query("change_report", "report", "SELECT * FROM report", keys="prev_date curr_date consensus_changed has_changes", ints="n_changed n_unchanged")(
    lambda spark, sf: cons.change_report(cons.compare_assets(snapshots(spark, sf)), cons.consensus_change(snapshot_consensus(spark, sf))))

_tick = """CASE c_mktsegment WHEN 'BUILDING' THEN ['A'] WHEN 'AUTOMOBILE' THEN ['N', 'R'] WHEN 'MACHINERY' THEN ['*'] WHEN 'HOUSEHOLD' THEN ['X', 'A'] ELSE NULL END"""
cte("subs", "", f"""
SELECT 'k' || c_custkey AS subscriber_id, CASE WHEN c_acctbal > 5000 AND c_nationkey % 5 = 0 THEN NULL ELSE c_name || '@example.org' END AS email, CASE WHEN c_acctbal > 5000 THEN 'https://hooks.example.org/' || c_custkey END AS webhook_url, {_tick} AS tickers,
 CASE WHEN c_nationkey < 12 THEN true WHEN c_nationkey < 20 THEN false END AS notify_consensus, CASE WHEN c_acctbal < 0 THEN false WHEN c_acctbal < 4000 THEN true END AS active FROM customer""")


def subscribers(spark, sf):
    seg = F.col("c_mktsegment")
    tickers = (F.when(seg == "BUILDING", F.array(F.lit("A"))).when(seg == "AUTOMOBILE", F.array(F.lit("N"), F.lit("R")))
               .when(seg == "MACHINERY", F.array(F.lit("*"))).when(seg == "HOUSEHOLD", F.array(F.lit("X"), F.lit("A"))))
    return td.table(spark, sf, "customer").select(
        F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("subscriber_id"),
        F.when(~((F.col("c_acctbal") > 5000) & (F.col("c_nationkey") % 5 == 0)), F.concat("c_name", F.lit("@example.org"))).alias("email"),
        F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("https://hooks.example.org/"), F.col("c_custkey").cast("string"))).alias("webhook_url"),
        tickers.alias("tickers"), F.when(F.col("c_nationkey") < 12, True).when(F.col("c_nationkey") < 20, False).alias("notify_consensus"),
        F.when(F.col("c_acctbal") < 0, False).when(F.col("c_acctbal") < 4000, True).alias("active"))


query("active_subscribers", "subs", "SELECT * FROM subs WHERE coalesce(active, true)", keys="subscriber_id email webhook_url")(
    lambda spark, sf: alerts.active_subscribers(subscribers(spark, sf)))
# a change log in which every order is an add and finished orders of open accounts remove
cte("sub_log", "", """
SELECT o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 250000 THEN 'remove' ELSE 'add' END AS op,
 CASE WHEN o_orderpriority <> '5-LOW' THEN 'c' || o_custkey || '@example.org' END AS email,
 CASE WHEN o_totalprice < 150000 THEN 'https://hooks.example.org/' || o_orderkey END AS webhook_url,
 CASE WHEN o_totalprice > 100000 THEN o_orderstatus END AS ticker, o_totalprice > 50000 AS notify_consensus FROM orders""")
query("upsert_subscribers", "sub_log", """
SELECT k AS subscriber_id, email, arg_max(webhook_url, seq) FILTER (WHERE op = 'add' AND webhook_url IS NOT NULL) AS webhook_url,
 coalesce(arg_max(ticker, seq) FILTER (WHERE op = 'add' AND ticker IS NOT NULL), '*') AS tickers,
 arg_min(notify_consensus, seq) FILTER (WHERE op = 'add') AS notify_consensus, arg_max(op, seq) = 'add' AS active
FROM (SELECT *, coalesce('e:' || email, 's:' || seq) AS k FROM sub_log WHERE op = 'remove' OR email IS NOT NULL OR webhook_url IS NOT NULL)
GROUP BY k, email HAVING count(*) FILTER (WHERE op = 'add') > 0""", keys="subscriber_id email webhook_url tickers notify_consensus active")(
    lambda spark, sf: alerts.fold_subscribers(td.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 250000), "remove").otherwise("add").alias("op"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.org"))).alias("email"),
        F.when(F.col("o_totalprice") < 150000, F.concat(F.lit("https://hooks.example.org/"), F.col("o_orderkey").cast("string"))).alias("webhook_url"),
        F.when(F.col("o_totalprice") > 100000, F.array("o_orderstatus")).alias("tickers"),
        (F.col("o_totalprice") > 50000).alias("notify_consensus"), F.col("o_orderdate").cast("string").alias("created_at")))
    .withColumn("tickers", F.array_join("tickers", ",")))

# alerts over all symbols whose label moved at any month: every change of the history is one candidate
cte("moved", "snaps", f"""
SELECT symbol, {_nm.format('a')} AS from_regime, {_nm.format('b')} AS to_regime FROM (
 SELECT symbol, arg_max(prev, generated_at) AS a, arg_max(label, generated_at) AS b FROM (
  SELECT *, lag(label) OVER (PARTITION BY symbol ORDER BY generated_at) AS prev FROM snaps) WHERE prev IS NOT NULL AND prev <> label GROUP BY symbol)""")


def latest_moves(spark, sf):
    """Each symbol's most recent label change."""
    from pyspark.sql import Window
    w = Window.partitionBy("symbol").orderBy("generated_at")
    s = snapshots(spark, sf).withColumn("prev", F.lag("label").over(w)).where("prev <> label")
    last = s.groupBy("symbol").agg(F.max_by("prev", "generated_at").alias("a"), F.max_by("label", "generated_at").alias("b"))
    names = F.create_map(*[F.lit(x) for kv in S.REGIME_NAMES.items() for x in kv])
    return last.select("symbol", names[F.col("a")].alias("from_regime"), names[F.col("b")].alias("to_regime"))


cte("subscr", "subs", """
SELECT *, CASE WHEN tickers IS NULL OR list_contains(tickers, '*') THEN '*' ELSE array_to_string(list_sort(list_distinct(tickers)), ',') END AS digest_id
FROM subs WHERE coalesce(active, true)""")
_mark = "CASE {0} WHEN 'Bull' THEN '🟢' WHEN 'Neutral' THEN '⚪' ELSE '🔴' END || ' ' || {0}"
cte("digest_lines", "subscr moved", f"""
SELECT d.digest_id, m.symbol, '  • ' || m.symbol || ' (' || m.symbol || '): ' || {_mark.format('from_regime')} || ' → ' || {_mark.format('to_regime')} AS line
FROM (SELECT DISTINCT digest_id FROM subscr) d JOIN moved m ON d.digest_id = '*' OR list_contains(string_split(d.digest_id, ','), m.symbol)""")
cte("digests", "digest_lines", """
SELECT digest_id, count(*) AS n_changes, array_to_string(list(symbol ORDER BY symbol)[1:3], ',') AS symbols, string_agg(line, chr(10) ORDER BY symbol) AS lines
FROM digest_lines GROUP BY 1""")
query("match_subscribers", "subscr digests", "SELECT s.subscriber_id, d.* FROM subscr s JOIN digests d ON s.digest_id = d.digest_id",
      keys="subscriber_id digest_id symbols", ints="n_changes")(
    lambda spark, sf: alerts.match_subscribers(alerts.active_subscribers(subscribers(spark, sf)), latest_moves(spark, sf))
    .withColumn("symbols", F.array_join("symbols", ",")))


def newest_change(spark, sf):
    """The newest change of the snapshots' consensus: at most one row."""
    return cons.consensus_change(snapshot_consensus(spark, sf)).orderBy(F.desc("generated_at")).limit(1)


_name = "CASE {} WHEN 0 THEN 'Bull' WHEN 1 THEN 'Neutral' WHEN 2 THEN 'Bear' END"
cte("newest_change", "snap_cons", f"""
SELECT chr(10) || 'Market Consensus: ' || a || ' (' || from_level || ') → ' || b || ' (' || to_level || ')' AS told FROM (
 SELECT generated_at, {_name.format('label')} AS b, {_name.format('lag(label) OVER (ORDER BY generated_at)')} AS a, level AS to_level,
  lag(level) OVER (ORDER BY generated_at) AS from_level FROM snap_cons)
WHERE a IS NOT NULL AND (a <> b OR from_level <> to_level) ORDER BY generated_at DESC LIMIT 1""")
cte("messages", "subscr digests newest_change", """
SELECT subscriber_id, email, webhook_url, digest_id, with_consensus, coalesce(n_changes, 0) AS n_changes, 'Regime Alert: ' || coalesce(replace(symbols, ',', ', '), '') ||
 CASE WHEN n_changes > 3 THEN ' +' || (n_changes - 3) || ' more' ELSE '' END || ' (2001-11-01)' AS subject, n_changes IS NOT NULL OR with_consensus AS hit FROM (
 SELECT s.*, coalesce(s.notify_consensus, true) AND (SELECT count(*) FROM newest_change) > 0 AS with_consensus, d.n_changes, d.symbols
 FROM subscr s LEFT JOIN digests d ON s.digest_id = d.digest_id)""")


def alert_parts(spark, sf):
    subs, moves = alerts.active_subscribers(subscribers(spark, sf)), stored(latest_moves(spark, sf))
    change = stored(newest_change(spark, sf))
    return subs, moves, change, alerts.outbox(subs, moves, change, "2001-11-01")


query("alert_messages", "messages", "SELECT * FROM messages WHERE hit", keys="subscriber_id digest_id with_consensus subject", ints="n_changes")(
    lambda spark, sf: alert_parts(spark, sf)[3])


@query("alert_bodies", "messages digests newest_change", """
SELECT digest_id, with_consensus, 'Regime Change Alert — 2001-11-01' || chr(10) || repeat('=', 50) || CASE WHEN with_consensus THEN chr(10) || told ELSE '' END || chr(10) ||
 coalesce(chr(10) || 'Regime Changes:' || chr(10) || lines, chr(10) || 'No individual asset regime changes.') || chr(10) || chr(10) || repeat('-', 50) || chr(10) ||
 'Regime Monitor | Unsubscribe: reply with UNSUBSCRIBE' AS body
FROM (SELECT DISTINCT m.digest_id, m.with_consensus, d.lines FROM messages m LEFT JOIN digests d ON m.digest_id = d.digest_id WHERE hit) LEFT JOIN newest_change ON true""",
       keys="digest_id with_consensus body")
def alert_bodies(spark, sf):
    subs, moves, change, messages = alert_parts(spark, sf)
    return alerts.bodies(messages, subs, moves, change, "2001-11-01")


@query("subscription_counts", "messages", """
SELECT sum(CASE WHEN hit THEN (email IS NOT NULL)::INT + (webhook_url IS NOT NULL)::INT ELSE 0 END) AS sent, count(*) FILTER (WHERE NOT hit) AS skipped FROM messages""",
       ints="sent skipped")
def subscription_counts(spark, sf):
    subs, _, _, messages = alert_parts(spark, sf)
    return alerts.dispatch_counts(subs, messages)


# ---- drift ---------------------------------------------------------------------------------------

PSI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_cut = "l_shipdate < TIMESTAMP '1998-06-01'"
_cells_sql = " UNION ALL ".join(f"SELECT '{c}' AS col, CASE WHEN {_cut} THEN 'ref' ELSE 'cur' END AS side, {c} AS x FROM lineitem" for c in PSI_COLS)
cte("drift_cells", "", _cells_sql)
cte("drift_edges", "drift_cells", """
SELECT col, list_sort(list_distinct(quantile_cont(x, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS edges FROM drift_cells WHERE side = 'ref' GROUP BY 1""")
cte("psi", "drift_cells drift_edges", """
SELECT col AS "column", any_value(nr) AS n_ref, any_value(nc) AS n_cur, CASE WHEN any_value(len_e) < 3 THEN 0 ELSE sum((c - r) * ln(c / r)) END AS psi FROM (
 SELECT *, greatest(rn / nr, 1e-4) AS r, greatest(cn / nc, 1e-4) AS c FROM (
  SELECT *, sum(rn) OVER (PARTITION BY col) AS nr, sum(cn) OVER (PARTITION BY col) AS nc FROM (
   SELECT d.col, len(any_value(e.edges)) AS len_e, len(list_filter(e.edges[2:-2], lambda v: d.x >= v)) AS bin, count(*) FILTER (WHERE side = 'ref') AS rn,
    count(*) FILTER (WHERE side = 'cur') AS cn FROM drift_cells d JOIN drift_edges e ON d.col = e.col GROUP BY d.col, bin))) GROUP BY col""")


def drift_sides(spark, sf):
    li = td.table(spark, sf, "lineitem").select(*PSI_COLS, "l_shipdate")
    cut = F.lit("1998-06-01").cast("timestamp")
    return li.where(F.col("l_shipdate") < cut), li.where(F.col("l_shipdate") >= cut)


def _psi(spark, sf):
    return drift.psi(*drift_sides(spark, sf), PSI_COLS)


query("population_stability", "psi", 'SELECT "column" AS feature, n_ref, n_cur, psi FROM psi', keys="feature", ints="n_ref n_cur", floats="psi")(
    lambda spark, sf: _psi(spark, sf).withColumnRenamed("column", "feature"))


def vector_sides(spark, sf):
    e = td.table(spark, sf, "embeddings")
    return e.where("label < 5"), e.where("label >= 5")


@query("mmd_rbf")
def mmd_rbf(spark, sf):
    """Kernel discrepancy of the embeddings by label half, bandwidth by the median distance, over whole tables."""
    return drift.mmd_rbf(*vector_sides(spark, sf), "embedding", "vec_id", dim=64)


@query("mmd_fourier")
def mmd_fourier(spark, sf):
    """Whole-table form of the same discrepancy."""
    a, b = vector_sides(spark, sf)
    return drift.mmd_fourier(a, b, "embedding", dim=64, scale=2.0)


cte("calibration", "", """
SELECT l_returnflag AS symbol, abs(avg((l_discount < 0.09)::INT) FILTER (WHERE NOT c) - 0.9) - abs(avg((l_discount < 0.09)::INT) FILTER (WHERE c) - 0.9) AS cal_drift
FROM (SELECT *, l_shipdate < TIMESTAMP '1998-06-01' AS c FROM lineitem) GROUP BY 1""")


@query("calibration_drift", "calibration", "SELECT * FROM calibration", keys="symbol", floats="cal_drift")
def calibration(spark, sf):
    """Coverage of a discount bound before and after the cut, against 90 %."""
    return (td.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("symbol")).agg(
        F.avg(F.when(F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp"), (F.col("l_discount") < 0.09).cast("int"))).alias("_ref"),
        F.avg(F.when(F.col("l_shipdate") >= F.lit("1998-06-01").cast("timestamp"), (F.col("l_discount") < 0.09).cast("int"))).alias("_cur"))
            .select("symbol", drift.calibration_drift("_ref", "_cur", F.lit(0.9)).alias("cal_drift")))


@query("drift_check")
def drift_check(spark, sf):
    """Worst PSI over line items and embedding discrepancy against the alarm thresholds."""
    return drift.drift_check(_psi(spark, sf), mmd_rbf(spark, sf), calibration(spark, sf))
