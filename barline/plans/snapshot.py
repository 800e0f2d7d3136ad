"""Snapshot payloads, report tables and the diagnostics bundle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import lookup
from ..functions.frame import series
from ..operators import backtest as bt
from ..operators import diagnostics as diag
from ..operators import regimes as rg

FUSED = ["fusion_p0", "fusion_p1", "fusion_p2"]


def diagnostics_report(models: DataFrame, monthly: DataFrame, probs: Sequence[str]) -> DataFrame:
    """Long (symbol, section, metric, value) table of all regime diagnostics."""
    def melt(df: DataFrame, section: str, ids: Sequence[str] = ()) -> DataFrame:
        values = [c for c in df.columns if c not in ("symbol", *ids)]
        name = [F.lit(c) for c in values]
        prefix = [F.concat(F.lit(f"{i}="), F.col(i).cast("string"), F.lit(":")) for i in ids]
        cells = F.array(*[F.struct(F.concat(*prefix, n).alias("metric"), F.col(c).cast("double").alias("value"))
                          for c, n in zip(values, name)])
        return df.select("symbol", F.lit(section).alias("section"), F.inline(cells))

    parts = [
        melt(diag.recession_alignment(models.select("symbol", "pos", "ts", "label"), monthly), "alignment"),
        melt(diag.calibration_error(diag.reliability_bins(models, probs)), "calibration", ["class"]),
        melt(diag.regime_stability(models), "stability", ["label"]),
        melt(diag.concordance(models, "label", "gmm_label", "p_high"), "concordance")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def asset_state(models: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One nested row per symbol: last bar, confidence, consensus, risk, transitions and history.

    ``models`` has a row per bar with rule, volatility-state and fused outputs. History is the last
    two years, so every nested array is bounded.
    """
    bars = models.withColumns({
        "position": lookup("label", S.REGIME_ALLOC),
        "switch_position": F.col("p_low") * S.SWITCHING_ALLOC[0] + F.col("p_high") * S.SWITCHING_ALLOC[1]})
    bars = rg.confidence(bars, FUSED)
    bars = rg.model_consensus(bars, {"rule": "label", "gmm": "gmm_label", "tvtp": "vol_label"}, "fusion_label")
    curves = bt.equity_curves(bars.withColumn("r", F.log(F.col("close")) - F.lag(F.log(F.col("close"))).over(series())),
                              {"switch": "switch_position", "rule": "position"}, S.HISTORY_BARS)
    history = curves.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct(
        F.col("ts").alias("date"), "close", "label", "position", "p_0", "p_1", "p_2", "gmm_label", "p_low", "p_high",
        "fusion_label", *FUSED, "entropy", "eq_switch", "eq_rule", "eq_bh"))).alias("history"))
    last = bars.groupBy("symbol").agg(F.max_by(F.struct(
        F.col("ts").alias("as_of"), F.col("close").alias("current_close"),
        F.struct("label", lookup("label", S.REGIME_NAMES).alias("name"), F.col("position").alias("alloc"),
                 lookup("label", S.REGIME_COLORS).alias("color"), F.array("p_0", "p_1", "p_2").alias("probs")).alias("current_regime"),
        F.struct(F.col("p_low").alias("p_low_vol"), F.col("p_high").alias("p_high_vol"), F.col("switch_position").alias("position"),
                 F.when(F.col("switch_position") > 0, "Low-Vol Bull").otherwise("High-Vol Defense").alias("state")).alias("current_tvtp"),
        F.struct(F.col("gmm_label").alias("label"), lookup("gmm_label", S.REGIME_NAMES).alias("name")).alias("current_gmm"),
        F.struct(F.col("fusion_label").alias("label"), lookup("fusion_label", S.REGIME_NAMES).alias("name"),
                 F.array(*FUSED).alias("probs"), "entropy").alias("current_fusion"),
        F.struct(F.col("confidence").alias("level"), F.col("confidence_score").alias("score"), "top_regime", "second_regime",
                 "margin", "reason").alias("current_confidence"),
        F.struct("agreement_count", "agreement_pct", "dissenters", F.col("consensus_level").alias("level")).alias("model_consensus")),
        "pos").alias("_l")).select("symbol", "_l.*")
    risk = rg.transition_risk(models, FUSED).select("symbol", F.struct(
        F.col("risk_level").alias("level"), F.col("risk_score").alias("score"), "current_regime", F.col("streak").alias("days_in_regime"),
        "expected_remaining", "top_alternative", "reasons", F.lit("fusion").alias("source_model")).alias("transition_risk"))
    matrix = diag.transition_matrix(models).groupBy("symbol", "from_state").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("to_state", "probability"))), lambda x: x["probability"]).alias("row"))
    matrix = matrix.groupBy("symbol").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("from_state", "row"))), lambda x: x["row"]).alias("transition_matrix"))
    out = last.join(risk, "symbol", "left").join(matrix, "symbol", "left").join(history, "symbol", "left")
    if names is None:
        return out.withColumn("name", F.col("symbol"))
    return out.join(names.select("symbol", F.col("name").alias("_name")), "symbol", "left").withColumn(
        "name", F.coalesce("_name", "symbol")).drop("_name")


def snapshot_summary(payloads: DataFrame, generated_at: Column) -> DataFrame:
    """Flat snapshot rows for change detection and consensus."""
    return payloads.select(generated_at.alias("generated_at"), "symbol", "name", "as_of", F.col("current_close").alias("close"),
                           F.col("current_regime.label").alias("label"), F.col("current_regime.name").alias("regime"),
                           F.col("transition_risk.level").alias("risk_level"))


def verdict(pbo: str = "pbo") -> Column:
    p = F.col(pbo)
    return F.when(p.isNull(), "not computed").when(p < 0.5, "generalises").when(p < 0.7, "borderline").otherwise("severe overfitting")


def strategy_table(report: DataFrame) -> DataFrame:
    """Per-strategy section of the validation report."""
    return report.select("symbol", "strategy", "n_paths", "sharpe_p05", "sharpe_p50", "sharpe_p95", "sharpe_mean", "max_dd_p50",
                         "dsr_p_value", "dsr_sharpe", "pbo", verdict().alias("pbo_verdict"))


def robustness_table(evaluated: DataFrame) -> DataFrame:
    """Per-asset section: tick for positive Sharpe, cross for not, dash for failed."""
    ok = F.col("error").isNull() & F.col("sharpe_p50").isNotNull()
    note = F.when(F.col("error").isNull(), "").otherwise(F.concat(F.lit("FAILED: "), "error"))
    return evaluated.select("symbol", "n_bars", "sharpe_p05", "sharpe_p50", "sharpe_p95", "max_dd_p50",
                            F.when(ok & (F.col("sharpe_p50") > 0), "✓").when(ok, "✗").otherwise("—").alias("positive"), note.alias("notes"))


def recent_history(payloads: DataFrame, days: int = 252) -> DataFrame:
    """History rows of the last ``days`` bars from nested payloads."""
    n = max(1, min(days, S.HISTORY_BARS))
    return payloads.select("symbol", F.inline(F.slice("history", -F.least(F.lit(n), F.size("history")), F.lit(n))))


