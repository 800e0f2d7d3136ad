"""Rule-based regime classification and the signals derived from its probabilities."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import ColumnOrName, argmax, clip, col, lookup, safe_div, with_softmax
from ..functions.frame import runs, series
from .features import minmax_normalise

P = ["p_0", "p_1", "p_2"]
SEQUENCE = ("symbol string, pos int, ts date, p_0 double, p_1 double, p_2 double, "
            "label int, position double")


def rule_scores(features: DataFrame) -> DataFrame:
    """Adds norm-space scores s_0..s_2: weighted sums of range-normalised features.

    A feature the frame lacks counts as 0.5. Bear reads gated features through a ramp that starts
    at the middle of the range.
    """
    present = [c for c in S.RULE_FEATURES if c in features.columns]
    df = minmax_normalise(features, {f"_n_{c}": c for c in present})

    def term(regime: int, c: str, weight: float) -> str:
        x = f"_n_{c}" if c in present else "0.5D"
        if regime == 2 and c in S.TAIL_GATED:
            x = f"least(greatest(({x} - 0.5D) * 2D, 0D), 1D)"
        return f"{weight!r}D * {x}"

    scores = [" + ".join(term(k, c, w) for c, w in zip(S.RULE_FEATURES, S.RULE_WEIGHTS[k]) if w)
              + f" AS s_{k}" for k in range(3)]
    vol = "_n_vol_ewma" if "vol_ewma" in present else "0.5D"
    return df.selectExpr(*features.columns, *[s.replace("+ -", "- ") for s in scores], f"{vol} AS vol_n")


def rule_probabilities(scores: DataFrame) -> DataFrame:
    return with_softmax(scores, [F.col(f"s_{k}") for k in range(3)], P, S.SOFTMAX_TEMP)


def risk_confirm(label: ColumnOrName, shock: ColumnOrName, dd: ColumnOrName) -> Column:
    """Force Bear on a large shock or drawdown; drop an unconfirmed Bear to the next best."""
    k, s, d = col(label), F.abs(col(shock)), F.abs(col(dd))
    promote = (k != 2) & ((s > S.PROMOTE_SHOCK) | (d > S.PROMOTE_DD))
    demote = (k == 2) & ~((s > S.DEMOTE_SHOCK) & (d > S.DEMOTE_DD))
    fallback = F.when(F.col("p_0") >= F.col("p_1"), 0).otherwise(1)
    return F.when(promote, 2).when(demote, fallback).otherwise(k)


def raw_regimes(features: DataFrame) -> DataFrame:
    """Memoryless part of the classifier: scores, probabilities, confirmed argmax label."""
    df = rule_probabilities(rule_scores(features))
    best = argmax([F.col(p) for p in P])
    zero = F.lit(0.0)
    return df.withColumn("raw_label", best).withColumn("label", risk_confirm(
        "raw_label", F.coalesce("shock_z", zero), F.coalesce("drawdown_252", zero)))


class RegimeState:
    """State carried from bar to bar of one series: current label, its age, last raw label, last vol."""

    __slots__ = ("current", "age", "raw", "vol")

    def __init__(self, current=None, age=0, raw=None, vol=None):
        self.current, self.age, self.raw, self.vol = current, age, raw, vol

    def step(self, scores: np.ndarray, vol: float, shock: float, dd: float) -> tuple[np.ndarray, int]:
        """One bar: penalise an over-held state, confirm, then switch only past the hysteresis."""
        sc = scores.copy()
        if self.current is not None and self.age > S.OVEREXT_BARS:
            sc[self.current] *= 1.0 - S.OVEREXT_PENALTY
        rising = self.vol is not None and vol > self.vol
        if self.current == 1 and self.age > S.STALE_NEUTRAL_BARS and rising:
            sc[1] = min(sc[1], max(sc[0], sc[2]) - 0.01)
        e = np.exp((sc - sc.max()) * S.SOFTMAX_TEMP)
        p = e / e.sum()
        raw = int(p.argmax())
        if raw != 2 and (shock > S.PROMOTE_SHOCK or dd > S.PROMOTE_DD):
            raw = 2
        elif raw == 2 and not (shock > S.DEMOTE_SHOCK and dd > S.DEMOTE_DD):
            raw = 0 if p[0] >= p[1] else 1
        # a majority of two is the older vote whenever they differ
        wanted = raw if self.raw is None else self.raw
        self.raw, self.vol = raw, vol
        if self.current is None:
            self.current, self.age = wanted, 1
        elif wanted != self.current and p[wanted] - p[self.current] > S.HYSTERESIS and self.age >= S.MIN_PERSIST:
            self.current, self.age = wanted, 1
        else:
            self.age += 1
        return p, self.current


def _sequence(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("pos")
    state = RegimeState()
    rows = [state.step(s, v, k, d) for s, v, k, d in zip(
        pdf[["s_0", "s_1", "s_2"]].to_numpy(), pdf["vol_n"].to_numpy(), pdf["shock"].to_numpy(), pdf["dd"].to_numpy())]
    out = pdf[["symbol", "pos", "ts"]].copy()
    out[P] = np.array([p for p, _ in rows])
    out["label"] = np.array([k for _, k in rows], dtype="int32")
    out["position"] = out["label"].map(S.REGIME_ALLOC).astype(float)
    return out


def step_inputs(features: DataFrame) -> DataFrame:
    """Columns the stateful step reads, everything else pruned before Python sees it."""
    zero = F.lit(0.0)
    return rule_scores(features).select(
        "symbol", "pos", "ts", "s_0", "s_1", "s_2", "vol_n",
        F.abs(F.coalesce("shock_z", zero)).alias("shock"), F.abs(F.coalesce("drawdown_252", zero)).alias("dd"))


def rule_sequence(features: DataFrame) -> DataFrame:
    """Stabilised regimes. Scores are windows in the JVM; only the recursion is a grouped map, over
    one daily series at a time (bounded by the calendar)."""
    out = step_inputs(features).groupBy("symbol").applyInPandas(_sequence, SEQUENCE)
    return out.withColumn("regime", lookup("label", S.REGIME_NAMES))


def rule_strategy(split: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rule positions on the test rows of each path, with state carried in from the path's train rows."""
    return rule_positions(split, features).where("role = 'test'")


def rule_positions(split: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rule positions on the train and test rows of each path.

    Every (symbol, path) is its own series: train and test rows together, in time order.
    """
    rows = split.where("role IN ('train', 'test')").withColumn("_key", F.concat_ws("#", "symbol", "path_id"))
    key = rows.select(F.col("_key").alias("symbol"), F.col("symbol").alias("_sym"), "path_id", "role", "pos", "ts", *features)
    seq = rule_sequence(key.drop("_sym", "path_id", "role")).select("symbol", "pos", "position")
    out = key.select("symbol", "_sym", "path_id", "role", "pos").join(seq, ["symbol", "pos"])
    return out.select(F.col("_sym").alias("symbol"), "path_id", "role", "pos", "position")


def confirmed_label(label: ColumnOrName = "label", probs: Sequence[str] = P, stale: float = 0.25,
                    dominant: float = 0.55) -> Column:
    """Keep the label unless its own probability went stale and another dominates."""
    k = col(label)
    arr = F.array(*probs)
    own = F.get(arr, k.cast("int"))
    others = [F.when(k != i, F.col(p)) for i, p in enumerate(probs)]
    best = F.greatest(*others)
    return F.when(own.isNull() | (own >= stale) | ~(best > dominant), k).otherwise(argmax(others))


def vol_state_class(low: ColumnOrName, high: ColumnOrName, floor: float = 0.60) -> Column:
    """Two-state volatility probabilities as Bull / Neutral / Bear."""
    a, b = col(low), col(high)
    x, y = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
    return F.when(a.isNull() & b.isNull(), None).when(F.greatest(x, y) < floor, 1).when(x >= y, 0).otherwise(2)


def entropy(probs: Sequence[ColumnOrName] = P, eps: float = 1e-12) -> Column:
    terms = [col(p) * F.ln(col(p) + F.lit(eps)) for p in probs]
    return -sum(terms[1:], terms[0]) / F.lit(math.log(len(probs)))


def top_two(probs: Sequence[str] = P) -> tuple[Column, Column]:
    """Two largest as structs (p, idx); equal values keep index order."""
    items = F.array(*[F.struct(F.col(p).alias("p"), F.lit(-i).alias("i")) for i, p in enumerate(probs)])
    ranked = F.sort_array(F.filter(items, lambda x: x["p"].isNotNull()), asc=False)
    return F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))


def confidence(df: DataFrame, probs: Sequence[str] = P, ent: str | None = "entropy") -> DataFrame:
    """Certainty level, score, margin and a readable reason."""
    top, second = top_two(probs)
    df = df.withColumns({"_t": top, "_s": second})
    p1, p2 = F.col("_t.p"), F.coalesce(F.col("_s.p"), F.lit(0.0))
    level = F.when((p1 > 0.65) & (p2 < 0.25), "high").when(p1 > 0.50, "medium").otherwise("low")
    names = S.REGIME_NAMES
    top_name, second_name = lookup(-F.col("_t.i"), names), lookup(-F.col("_s.i"), names)
    text = F.format_string("P(%s)=%.2f leads P(%s)=%.2f by %.2f", top_name, p1, second_name, p2, p1 - p2)
    score = p1
    if ent is not None:
        text = F.when(F.col(ent).isNull(), text).otherwise(F.concat(text, F.format_string("; entropy=%.2f", F.col(ent))))
        score = F.coalesce(clip(1 - F.col(ent), 0.0, 1.0), p1)
    none = F.col("_t").isNull()
    return df.withColumns({
        "confidence": F.when(none, "low").otherwise(level),
        "confidence_score": F.when(none, 0.0).otherwise(score), "top_regime": top_name, "second_regime": second_name,
        "margin": p1 - p2, "reason": F.when(none, "no probability vector available").otherwise(text)}).drop("_t", "_s")


def model_consensus(df: DataFrame, models: dict[str, str], reference: str) -> DataFrame:
    """How many models agree with the reference label, who dissents, and a level name."""
    ref = F.col(reference)
    votes = F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).cast("int").alias("label")) for n, c in models.items()])
    valid = F.filter(votes, lambda v: v["label"].isNotNull())
    agree = F.size(F.filter(valid, lambda v: v["label"] == ref))
    out = df.withColumns({
        "agreement_count": agree, "_n": F.size(valid),
        "dissenters": F.transform(F.filter(valid, lambda v: v["label"] != ref), lambda v: v["model"])})
    level = F.when(F.col("agreement_count") == 3, "unanimous").when(F.col("agreement_count") == 2, "strong").when(
        F.col("agreement_count") == 1, "split").otherwise("divided")
    return out.withColumns({"agreement_pct": F.coalesce(F.col("agreement_count") / F.nullif(F.col("_n"), F.lit(0)), F.lit(0.0)),
                            "consensus_level": level}).drop("_n")


def margin_compression(df: DataFrame, probs: Sequence[str] = P, lookback: int = 5) -> DataFrame:
    """Shrinkage of the top-two margin against ``lookback`` bars ago, as a score in [0, 1]."""
    top, second = top_two(probs)
    df = df.withColumn("margin_now", top["p"] - second["p"])
    df = df.withColumn("margin_lookback", F.lag("margin_now", lookback).over(series()))
    now, then = F.col("margin_now"), F.col("margin_lookback")
    change = F.when(now.isNull() | then.isNull(), None).when(then <= 1e-9, 0.0).otherwise(
        1 - now / F.nullif(then, F.lit(0.0)))
    return df.withColumn("compression", change).withColumn(
        "margin_score", F.coalesce(clip("compression", 0.0, 1.0), F.lit(0.0)))


def runner_up_acceleration(df: DataFrame, probs: Sequence[str] = P, window: int = 5, full: float = 0.20) -> DataFrame:
    """Rise of today's second-best probability over ``window`` bars, as a score in [0, 1]."""
    _, second = top_two(probs)
    df = df.withColumns({"_s": second, "_past": F.lag(F.array(*probs), window).over(series())})
    df = df.withColumns({"second_regime": -F.col("_s.i"), "second_prob": F.col("_s.p")})
    delta = F.col("second_prob") - F.get("_past", F.col("second_regime"))
    return df.withColumn("second_delta", delta).withColumn(
        "accel_score", F.coalesce(clip(F.col("second_delta") / F.lit(full), 0.0, 1.0), F.lit(0.0))).drop("_s", "_past")


def regime_persistence(labels: DataFrame, label: str = "label") -> DataFrame:
    """Current streak against completed past runs of the same regime, one row per symbol."""
    r = runs(labels, label)
    now = r.where(~F.col("completed")).select("symbol", label, F.col("run_len").alias("streak"))
    past = r.where("completed").select("symbol", label, "run_len")
    hist = now.join(past, ["symbol", label], "left").groupBy("symbol", label, "streak").agg(
        F.count("run_len").alias("n_past"), F.percentile("run_len", F.lit(0.5)).alias("median_len"),
        F.percentile("run_len", F.lit(0.75)).alias("p75_len"),
        F.avg(F.when(F.col("run_len") <= F.col("streak"), 1.0).when(F.col("run_len").isNotNull(), 0.0)).alias("_pct"))
    s, med, p75 = F.col("streak"), F.col("median_len"), F.col("p75_len")
    mid = 0.3 * (s - med) / F.greatest(p75 - med, F.lit(1.0))
    late = F.least(F.lit(1.0), 0.3 + 0.7 * (s - p75) / F.greatest(p75, F.lit(1.0)))
    score = F.when(F.col("n_past") == 0, 0.0).when(s <= med, 0.0).when(s <= p75, mid).otherwise(late)
    return hist.select("symbol", label, "streak", "n_past", "median_len", "p75_len",
                       F.coalesce("_pct", F.lit(0.0)).alias("percentile"),
                       F.coalesce(F.greatest(F.lit(0.0), F.bround(med - s)), F.lit(0.0)).cast("int").alias("expected_remaining"),
                       clip(score, 0.0, 1.0).alias("persist_score"))


def transition_risk(df: DataFrame, probs: Sequence[str] = P, label: str = "label", lookback: int = 5) -> DataFrame:
    """Blend of margin, persistence and challenger signals at the last bar of each symbol."""
    bars = runner_up_acceleration(margin_compression(df, probs, lookback), probs, lookback)
    last = bars.groupBy("symbol").agg(F.max_by(F.struct(
        "ts", "margin_now", "margin_lookback", "compression", "margin_score", "second_regime", "second_delta",
        "accel_score"), "pos").alias("_l")).select("symbol", "_l.*")
    out = last.join(regime_persistence(df, label), "symbol")
    out = out.withColumn("risk_score", clip(
        0.4 * F.col("margin_score") + 0.3 * F.col("persist_score") + 0.3 * F.col("accel_score"), 0.0, 1.0))
    level = F.when(F.col("risk_score") >= 0.5, "high").when(F.col("risk_score") >= 0.3, "medium").otherwise("low")
    name, other = lookup(label, S.REGIME_NAMES), F.coalesce(lookup("second_regime", S.REGIME_NAMES), F.lit("—"))
    reasons = F.array_compact(F.array(
        F.when((F.col("margin_score") >= 0.4) & F.col("compression").isNotNull(), F.format_string(
            f"top-second margin shrunk %.0f%% over last {lookback} bars (%.2f → %.2f)",
            F.col("compression") * 100, F.col("margin_lookback"), F.col("margin_now"))),
        F.when(F.col("persist_score") >= 0.4, F.format_string(
            "%s regime held for %d bars (typical p75 = %.0f, percentile = %.0f%%)",
            name, F.col("streak"), F.col("p75_len"), F.col("percentile") * 100)),
        F.when((F.col("accel_score") >= 0.4) & F.col("second_delta").isNotNull(), F.format_string(
            f"P(%s) rising %+.0f pp over last {lookback} bars", other, F.col("second_delta") * 100))))
    quiet = F.array(F.lit("all sub-signals below alert thresholds"))
    return out.withColumns({"risk_level": level, "current_regime": name, "top_alternative": other,
                            "reasons": F.when(F.size(reasons) == 0, quiet).otherwise(reasons)})


def log_opinion_pool(df: DataFrame, first: Sequence[str], second: Sequence[str], out: Sequence[str],
                     eps: float = 1e-9) -> DataFrame:
    """Normalised product of two class-probability vectors."""
    logs = [F.ln(F.col(a) + F.lit(eps)) + F.ln(F.col(b) + F.lit(eps)) for a, b in zip(first, second)]
    return with_softmax(df, logs, list(out))


def state_mapping(df: DataFrame, label: str = "label", min_bars: int = 30) -> DataFrame:
    """P(class | volatility state) per symbol from probability-weighted label counts.

    One row per symbol with m_<state>_<class>; short series or empty states use the prior.
    """
    mass = [F.sum(F.when(F.col(label) == k, F.col(p)).otherwise(0.0)).alias(f"_m_{s}_{k}")
            for s, p in enumerate(("p_low", "p_high")) for k in range(3)]
    agg = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"), F.sum("p_low").alias("_t_0"),
                                   F.sum("p_high").alias("_t_1"), *mass)
    return agg.select("symbol", *[
        F.when((F.col("_n") >= min_bars) & (F.col(f"_t_{s}") > 1e-6), safe_div(f"_m_{s}_{k}", f"_t_{s}"))
        .otherwise(S.VOL_STATE_PRIOR[s][k]).alias(f"m_{s}_{k}") for s in range(2) for k in range(3)])


def fuse(df: DataFrame, mapping: DataFrame, first: Sequence[str] = P) -> DataFrame:
    """Pool class probabilities with volatility-state probabilities lifted to classes."""
    joined = df.join(mapping, "symbol")
    lifted = {f"_v_{k}": F.coalesce("p_low", F.lit(0.5)) * F.col(f"m_0_{k}")
              + F.coalesce("p_high", F.lit(0.5)) * F.col(f"m_1_{k}") for k in range(3)}
    out = log_opinion_pool(joined.withColumns(lifted), first, list(lifted), ["fusion_p0", "fusion_p1", "fusion_p2"])
    keep = [*df.columns, "fusion_p0", "fusion_p1", "fusion_p2"]
    f = ["fusion_p0", "fusion_p1", "fusion_p2"]
    return out.select(*keep).withColumns({"fusion_label": argmax([F.col(p) for p in f]), "entropy": entropy(f)})


def gated_position(position: ColumnOrName, p_change: ColumnOrName, smooth: bool = True, threshold: float = 0.7) -> Column:
    """Damp a position by the chance of a regime change, smoothly or with a hard cut."""
    p = col(p_change)
    return col(position) * (clip(1 - p, 0.0, 1.0) if smooth else F.when(p <= threshold, 1.0).otherwise(0.0))
