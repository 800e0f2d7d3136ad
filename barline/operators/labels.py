"""Path-dependent labels and sample weights over a (symbol, pos, close, vol) frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frame import UNB, series


def triple_barrier(df: DataFrame, vol: str = "vol_ewma", pi_up: float = 2.0,
                   pi_down: float | None = None, horizon: int = 10) -> DataFrame:
    """First touch of a volatility-scaled band within ``horizon`` bars.

    Adds t1 (position where the label resolves), ret (log return to t1) and label in {-1, 0, 1}.
    Only the next ``horizon`` bars are gathered per row, a bounded frame.
    """
    pi_down = pi_up if pi_down is None else pi_down
    if pi_up <= 0 or pi_down <= 0 or horizon < 1:
        raise ValueError("barrier widths must be positive and horizon at least 1")
    w = series()
    c, s = F.col("close"), F.col(vol)
    usable = c.isNotNull() & s.isNotNull() & ~F.isnan(s) & (s > 0)
    upper, lower = c * (1 + F.lit(pi_up) * s), c * (1 - F.lit(pi_down) * s)
    ahead = F.collect_list(F.struct("pos", "close")).over(w.rowsBetween(1, horizon))
    touch = F.get(F.filter(ahead, lambda x: (x["close"] >= upper) | (x["close"] <= lower)), F.lit(0))
    last_pos = F.max("pos").over(Window.partitionBy("symbol"))
    out = df.withColumns({"_hit": F.when(usable, touch),
                          "_end": F.least(F.col("pos") + horizon, last_pos),
                          "_upper": upper, "_stay": F.last("close").over(w.rowsBetween(0, horizon))})
    hit_close = F.col("_hit.close")
    resolved = F.coalesce(hit_close, F.col("_stay"))
    return out.withColumns({
        "t1": F.coalesce(F.col("_hit.pos"), F.col("_end")).cast("int"),
        "ret": F.when((c > 0) & (resolved > 0), F.ln(resolved / c)),
        "label": F.when(F.col("_hit").isNull(), 0).when(hit_close >= F.col("_upper"), 1).otherwise(-1),
    }).drop("_hit", "_end", "_upper", "_stay")


def label_horizon(labels: DataFrame) -> DataFrame:
    return labels.withColumn("horizon", F.col("t1") - F.col("pos"))


def label_balance(labels: DataFrame) -> DataFrame:
    """Share of each label per symbol; one row per (symbol, label)."""
    n = labels.groupBy("symbol", "label").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy("symbol")))


def label_concurrency(labels: DataFrame) -> DataFrame:
    """How many label spans [pos, t1] cover each bar: starts so far minus ends before it."""
    ends = labels.groupBy("symbol", F.col("t1").alias("pos")).agg(F.count(F.lit(1)).alias("_ends"))
    w = series()
    out = labels.join(ends, ["symbol", "pos"], "left")
    ended = F.sum(F.coalesce("_ends", F.lit(0))).over(w.rowsBetween(UNB, -1))
    return out.withColumn("concurrency", F.greatest(
        F.count(F.lit(1)).over(w.rowsBetween(UNB, 0)) - F.coalesce(ended, F.lit(0)), F.lit(1))
    ).drop("_ends")


def label_uniqueness(labels: DataFrame) -> DataFrame:
    """Mean of 1/concurrency over the label's own span, from one prefix sum and one equi-join."""
    w = series()
    c = label_concurrency(labels).withColumn("_inv", 1.0 / F.col("concurrency"))
    c = c.withColumn("_cum", F.sum("_inv").over(w.rowsBetween(UNB, 0)))
    upto = c.select("symbol", F.col("pos").alias("t1"), F.col("_cum").alias("_cum_t1"))
    out = c.join(upto, ["symbol", "t1"], "left")
    span = F.col("_cum_t1") - F.col("_cum") + F.col("_inv")
    return out.withColumn("uniqueness", F.when(
        F.col("t1") >= F.col("pos"), span / (F.col("t1") - F.col("pos") + 1)).otherwise(1.0)
    ).drop("_inv", "_cum", "_cum_t1")


def sample_weights(labels: DataFrame, decay: float = 1.0) -> DataFrame:
    """Uniqueness x magnitude x time decay, rescaled to mean 1 within the series."""
    whole = Window.partitionBy("symbol")
    u = label_uniqueness(labels)
    mu = F.avg(F.abs("ret")).over(whole)
    n = F.count(F.lit(1)).over(whole)
    magnitude = F.when(mu > 0, F.abs("ret") / mu).otherwise(1.0)
    age = (n - 1 - F.col("pos")) / F.nullif(n - 1, F.lit(0))
    out = u.withColumn("_w", F.col("uniqueness") * magnitude
                       * F.exp(F.lit(-float(decay)) * F.coalesce(age, F.lit(0.0))))
    mean = F.avg("_w").over(whole)
    return out.withColumn("weight", F.when(mean > 0, F.col("_w") / mean).otherwise(1.0)).drop("_w")


def transition_target(df: DataFrame, label: str = "label", horizon: int = 5) -> DataFrame:
    """1 when any of the next ``horizon`` labels differs; the unfinished tail is 0 and not fit."""
    ahead = series().rowsBetween(1, horizon)
    full = F.count(label).over(ahead) == horizon
    moved = (F.min(label).over(ahead) != F.col(label)) | (F.max(label).over(ahead) != F.col(label))
    return df.withColumns({"target": F.when(full & moved, 1).otherwise(0), "in_fit": full})
