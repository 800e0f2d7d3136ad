"""Regime diagnostics: alignment with a slow flag, calibration, stability and agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from ..functions.frame import UNB, runs, series, tail_rows

# Interior edges of ten equal bins as doubles.
BIN_EDGES = [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]


def flag_on_calendar(labels: DataFrame, monthly: DataFrame) -> DataFrame:
    """Monthly flag as each bar sees it: business days read their month, others the bar before.

    ``monthly`` has one row per month, so the join side is bounded by the calendar.
    """
    span = monthly.agg(F.min("month").alias("_first"), F.max("month").alias("_final")).withColumn("_one", F.lit(1))
    rows = labels.withColumns({"month": F.trunc("ts", "month"), "_one": F.lit(1)})
    rows = rows.join(monthly, "month", "left").join(F.broadcast(span), "_one")
    open_day = F.weekday("ts") < 5
    seen = F.when(open_day & (F.col("ts") >= F.col("_first")) & (F.col("ts") <= F.col("_final")), F.col("flag"))
    out = rows.withColumn("_seen", seen)
    carried = F.last("_seen", ignorenulls=True).over(series().rowsBetween(UNB, 0))
    return out.withColumn("flag", F.coalesce(carried, F.lit(0)).cast("int")).drop("_seen", "_one", "_first", "_final", "month")


def recession_alignment(labels: DataFrame, monthly: DataFrame) -> DataFrame:
    """Precision, recall and lead of Bear calls against the flag, per symbol."""
    df = flag_on_calendar(labels, monthly).withColumn("bear", (F.col("label") == 2).cast("int"))
    counts = df.groupBy("symbol").agg(
        F.sum("bear").alias("n_bear_bars"), F.sum("flag").alias("n_recession_bars"),
        F.sum(F.col("bear") * F.col("flag")).alias("n_overlap"))
    # an episode also owns the bar that ends it
    w = series()
    change = F.when(F.lag("flag").over(w).isNull() | (F.lag("flag").over(w) != F.col("flag")), 1).otherwise(0)
    marked = df.withColumn("_c", change).withColumn("_run", F.sum("_c").over(w.rowsBetween(UNB, 0)))
    episodes = marked.groupBy("symbol", "_run").agg(
        F.first("flag").alias("flag"), F.min("ts").alias("start"), F.min(F.when(F.col("bear") == 1, F.col("ts"))).alias("hit"),
        F.min_by("bear", "pos").alias("first_bear"))
    nw = Window.partitionBy("symbol").orderBy("_run")
    episodes = episodes.withColumns({"end": F.lead("start").over(nw), "end_bear": F.lead("first_bear").over(nw)})
    hit = F.coalesce("hit", F.when(F.col("end_bear") == 1, F.col("end")))
    lags = episodes.where("flag = 1 AND end IS NOT NULL").groupBy("symbol").agg(
        F.median(F.datediff(hit, "start")).cast("int").alias("median_days_to_bear"))
    out = counts.join(lags, "symbol", "left").withColumns({
        "_p": F.coalesce(safe_div(F.col("n_overlap").cast("double"), F.col("n_bear_bars").cast("double")), F.lit(0.0)),
        "_r": F.coalesce(safe_div(F.col("n_overlap").cast("double"), F.col("n_recession_bars").cast("double")), F.lit(0.0))})
    f1 = F.coalesce(safe_div(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r")), F.lit(0.0))
    return out.select("symbol", F.round("_p", 4).alias("precision"), F.round("_r", 4).alias("recall"),
                      F.round(f1, 4).alias("f1"), "median_days_to_bear", "n_recession_bars", "n_bear_bars", "n_overlap")


def reliability_bins(df: DataFrame, probs: Sequence[str], label: str = "label",
                     keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Confidence and accuracy per class and equal-width bin; the last bin is closed."""
    per_class = F.inline(F.array(*[F.struct(F.lit(k).alias("class"), F.col(p).alias("p"),
                                            (F.col(label) == k).cast("double").alias("y")) for k, p in enumerate(probs)]))
    long = df.select(*keys, per_class)
    edge = F.lit(0)
    for e in BIN_EDGES:
        edge = edge + F.when(F.col("p") >= e, 1).otherwise(0)
    return long.withColumn("bin", edge).groupBy(*keys, "class", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("confidence"), F.avg("y").alias("accuracy"))


def calibration_error(bins: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Expected calibration error per class."""
    out = bins.groupBy(*keys, "class").agg(
        F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))).alias("_g"), F.sum("n").alias("n"))
    return out.select(*keys, "class", "n", F.round(F.col("_g") / F.col("n"), 4).alias("ece"))


def regime_stability(labels: DataFrame, label: str = "label") -> DataFrame:
    """Run-length statistics per regime, flip rate and the regime with the longest mean run."""
    r = runs(labels, label)
    per = r.groupBy("symbol", label).agg(
        F.avg("run_len").alias("_mean"), F.median("run_len").alias("median_duration"),
        F.count(F.lit(1)).alias("n_episodes"), F.sum("run_len").alias("_bars"))
    whole = Window.partitionBy("symbol")
    n, k = F.sum("_bars").over(whole), F.sum("n_episodes").over(whole)
    best = whole.orderBy(F.desc(F.round("_mean", 2)), label)
    out = per.withColumns({"n_bars": n, "_k": k, "dominant_regime": F.first(label).over(best)})
    return out.select("symbol", label, F.round("_mean", 2).alias("mean_duration"), "median_duration", "n_episodes",
                      F.round(F.col("_bars") / F.col("n_bars"), 4).alias("pct_time"),
                      F.round(F.coalesce((F.col("_k") - 1) / F.nullif(F.col("n_bars") - 1, F.lit(0)), F.lit(0.0)), 4).alias("flip_rate"),
                      "dominant_regime")


def cohen_kappa(df: DataFrame, a: str, b: str, classes: int = 3, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Chance-corrected agreement from one aggregate of marginals."""
    x, y = F.col(a), F.col(b)
    marg = [F.avg(F.when(c == k, 1.0).otherwise(0.0)).alias(f"_{n}{k}") for n, c in (("a", x), ("b", y)) for k in range(classes)]
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(x == y, 1.0).otherwise(0.0)).alias("_po"), *marg)
    pe = sum((F.col(f"_a{k}") * F.col(f"_b{k}") for k in range(1, classes)), F.col("_a0") * F.col("_b0"))
    out = out.withColumn("_pe", pe)
    degenerate = F.abs(1 - F.col("_pe")) < 1e-12
    kappa = F.when(degenerate, F.when(F.col("_po") >= 1, 1.0).otherwise(0.0)).otherwise(
        (F.col("_po") - F.col("_pe")) / F.nullif(1 - F.col("_pe"), F.lit(0.0)))
    return out.select(*keys, "n", kappa.alias("kappa"))


def concordance(df: DataFrame, first: str, second: str, p_high: str) -> DataFrame:
    """Pairwise and two-of-three agreement of three models per symbol.

    The third model calls Bear above one half, else Bull; missing labels count as Neutral and
    missing probabilities as one half.
    """
    r = F.coalesce(first, F.lit(1))
    g = F.coalesce(second, F.lit(1))
    t = F.when(F.coalesce(p_high, F.lit(0.5)) > 0.5, 2).otherwise(0)
    rows = df.select("symbol", r.alias("r"), g.alias("g"), t.alias("t"))

    def share(cond):
        return F.round(F.avg(F.when(cond, 1.0).otherwise(0.0)), 4)

    rr, gg, tt = F.col("r"), F.col("g"), F.col("t")
    out = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_aligned"), share(rr == gg).alias("first_second"),
        share((rr == 2) == (tt == 2)).alias("first_third"), share((gg == 2) == (tt == 2)).alias("second_third"),
        share((rr == gg) | (rr == tt) | (gg == tt)).alias("consensus_score"),
        *[F.count_if((rr == i) & (gg == j)).alias(f"c_{i}{j}") for i in range(3) for j in range(3)])
    kappa = cohen_kappa(rows, "r", "g").select("symbol", F.round("kappa", 4).alias("kappa"))
    return out.join(kappa, "symbol")


def transition_matrix(labels: DataFrame, label: str = "label", bars: int = 756, states: int = 3) -> DataFrame:
    """Row-normalised label transitions over the last bars; every state pair is present."""
    tail = tail_rows(labels, bars)
    pairs = tail.select("symbol", F.lag(label).over(series()).alias("from_state"), F.col(label).alias("to_state"))
    grid = tail.select("symbol").distinct().select("symbol", F.explode(F.array(*map(F.lit, range(states)))).alias("from_state")).select(
        "*", F.explode(F.array(*map(F.lit, range(states)))).alias("to_state"))
    n = pairs.where("from_state IS NOT NULL").groupBy("symbol", "from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    out = grid.join(n, ["symbol", "from_state", "to_state"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("symbol", "from_state"))
    return out.withColumn("probability", F.round(F.coalesce(F.col("n") / F.nullif(total, F.lit(0)), F.lit(0.0)), 4))


def regime_bands(labels: DataFrame, label: str = "label") -> DataFrame:
    """Maximal runs as dated bands; a band ends where the next begins, the last at its own last bar."""
    r = runs(labels, label, order="ts")
    return r.select("symbol", F.col("run_start").alias("band_start"), F.coalesce("next_start", "run_end").alias("band_end"), label)


def detector_metrics(df: DataFrame, predicted: str, target: str, in_fit: str = "in_fit", gate: float = 0.40) -> DataFrame:
    """Precision, recall and F1 of binary calls; NULL where only one class occurs."""
    y, p = F.col(target), F.col(predicted)
    c = df.where(F.col(in_fit)).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(y).alias("n_positive"), F.sum(p).alias("n_predicted"), F.sum(y * p).alias("_tp"))
    tp = F.col("_tp").cast("double")
    prec = F.coalesce(safe_div(tp, F.col("n_predicted").cast("double")), F.lit(0.0))
    rec = F.coalesce(safe_div(tp, F.col("n_positive").cast("double")), F.lit(0.0))
    f1 = F.coalesce(safe_div(2 * prec * rec, prec + rec), F.lit(0.0))
    both = (F.col("n_positive") > 0) & (F.col("n_positive") < F.col("_n"))
    return c.select("symbol", "n_positive", "n_predicted", F.when(both, prec).alias("precision"),
                    F.when(both, rec).alias("recall"), F.when(both, f1).alias("f1"),
                    (both & (f1 >= gate) & (prec >= gate)).alias("passes_gate"))
