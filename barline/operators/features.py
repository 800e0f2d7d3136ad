"""Causal feature table: every feature at bar t uses data through t-1 only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from ..functions.frame import (UNB, align_ffill, complete_cases, ffill, fill_dead_columns,
                               log_return, rolling, series, with_pos)
from ..functions.scan import ewm, ewm_recursive, rolling_blocks, rolling_range
from ..schema import (ANNUAL_BARS, AUX_SERIES, FEATURES_V1, FEATURES_V2, FEATURES_V2_ADD,
                      MIN_PERIODS, MOMENTUM_BARS, NORM_WINDOW, SHOCK_ALPHA, VOL_ALPHAS,
                      require_daily)
from pyspark.sql import Window


def with_return(bars: DataFrame) -> DataFrame:
    """Bars with position and close-to-close log return ``r``."""
    df = require_daily(bars)
    if "pos" not in df.columns:
        df = with_pos(df)
    return df.withColumn("r", log_return())


def momentum(df: DataFrame) -> DataFrame:
    """Sums of the last h returns. They telescope to a difference of log closes, so no frame is
    summed; a missing return anywhere in the window still gives NULL, by a running count."""
    w = series()
    out = df.withColumns({"_lc": F.ln(F.when(F.col("close") > 0, F.col("close"))),
                          "_n": F.count("r").over(w.rowsBetween(UNB, 0))})
    return out.withColumns({
        f"mom_{h}": F.when(F.col("_n") - F.lag("_n", h).over(w) == h, F.col("_lc") - F.lag("_lc", h).over(w))
        for h in MOMENTUM_BARS}).drop("_lc", "_n")


def ewm_volatility(df: DataFrame) -> DataFrame:
    """Four-horizon volatility pyramid, its two ratios and the shock z-score."""
    specs = {n: ("r", a) for n, a in VOL_ALPHAS.items()}
    specs["shock"] = ("abs(r)", SHOCK_ALPHA)
    out = ewm(df, specs, min_periods=MIN_PERIODS)
    return out.selectExpr(
        *df.columns, *[f"{n}_std AS {n}" for n in VOL_ALPHAS],
        "vol_short_std / nullif(vol_long_std, 0D) AS vol_ratio_sl",
        "vol_long_std / nullif(vol_yearly_std, 0D) AS vol_ratio_ly",
        "(abs(r) - shock_mean) / nullif(shock_std, 0D) AS shock_z")


def drawdown(df: DataFrame, n: int = 252) -> DataFrame:
    """Distance of the close from its trailing n-bar maximum."""
    out = rolling_range(df, ["close"], n, MIN_PERIODS)
    return out.withColumn("drawdown_252", F.col("close") / F.nullif("close_hi", F.lit(0.0)) - 1).drop("close_lo", "close_hi")


def trend_direction(df: DataFrame, short: int = 21, long: int = 63) -> DataFrame:
    out = rolling_blocks(df, long, {"_long": "close"})
    return out.withColumn("trend_dir", rolling(F.avg, "close", short) / F.col("_long") - 1).drop("_long")


def price_features(df: DataFrame) -> DataFrame:
    """The 14 price columns, not yet lagged. Input needs pos, close and r."""
    out = drawdown(ewm_volatility(momentum(df))).withColumn("_lag_r", F.lag("r").over(series()))
    # one pass over blocks of 63 rows for both
    out = rolling_blocks(out, 63, {"_long": "close"}, {"autocorr_63": ("r", "_lag_r")})
    return out.withColumn("trend_dir", rolling(F.avg, "close", 21) / F.col("_long") - 1).drop("_lag_r", "_long")


def lagged(df: DataFrame, columns: list[str], n: int = 1) -> DataFrame:
    return df.withColumns({c: F.lag(c, n).over(series()) for c in columns})


def features_v1(bars: DataFrame) -> DataFrame:
    """symbol, pos, ts, close, r and the 14 price features; complete rows only, pos renumbered."""
    full = lagged(price_features(with_return(bars.select(
        *[c for c in ("symbol", "pos", "ts", "close") if c in bars.columns]))), FEATURES_V1)
    return with_pos(complete_cases(full, FEATURES_V1)).select(
        "symbol", "pos", "ts", "close", "r", *FEATURES_V1)


def yang_zhang(n: int = 20) -> Column:
    """Annualised open-high-low-close volatility over n bars. Needs open, high, low, close."""
    w = series()
    o, h, l, c = (F.ln(F.when(F.col(x) > 0, F.col(x))) for x in ("open", "high", "low", "close"))
    overnight, day = o - F.lag(c).over(w), c - o
    rs = (h - c) * (h - o) + (l - c) * (l - o)
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    var = (rolling(F.var_samp, overnight, n) + F.lit(k) * rolling(F.var_samp, day, n)
           + F.lit(1 - k) * rolling(F.avg, rs, n))
    return F.sqrt(F.greatest(var, F.lit(0.0))) * F.lit(math.sqrt(ANNUAL_BARS))


def aux_bundle(aux: DataFrame) -> DataFrame:
    """One row per date with the ten named series; a missing series is a NULL column.

    The result is bounded by the calendar, not by the size of ``aux``.
    """
    return aux.groupBy("date").pivot("series_id", AUX_SERIES).agg(F.first("value"))


def log_floor(c: str) -> Column:
    return F.ln(F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(1e-9))))


def term_structure(df: DataFrame) -> DataFrame:
    """Level, change and shape of the aligned volatility indices, not yet lagged."""
    return df.withColumns({
        "vix_log": log_floor("vix"), "skew_log": log_floor("skew"), "vvix_log": log_floor("vvix"),
        "vix_change": F.col("vix") - F.lag("vix", 5).over(series()),
        "vix_term": safe_div("vix", "vix3m"),
        "vix_slope": F.col("vix3m") - F.col("vix"),
        "vix_curvature": 2 * F.col("vix") - F.col("vix9d") - F.col("vix3m"),
        "vix6m_slope": F.col("vix6m") - F.col("vix")})


def cross_correlation(df: DataFrame, columns: dict[str, str], n: int = 63) -> DataFrame:
    """Rolling correlation of ``r`` with the log return of aligned cross series."""
    rets = df.withColumns({f"_{c}_r": log_return(c) for c in columns.values()})
    return rolling_blocks(rets, n, corrs={out: ("r", f"_{c}_r") for out, c in columns.items()}).drop(
        *[f"_{c}_r" for c in columns.values()])


def features_v2(bars: DataFrame, aux_wide: DataFrame, ohlc: DataFrame | None = None) -> DataFrame:
    """The 27-column frame. ``ohlc`` counts only where it covers over 90 % of a series' dates."""
    base = with_return(bars.select(*[c for c in ("symbol", "pos", "ts", "close")
                                     if c in bars.columns]))
    df = align_ffill(price_features(base), aux_wide, AUX_SERIES)
    df = cross_correlation(term_structure(df), {"corr_tlt_63": "tlt", "corr_gld_63": "gld"})
    if ohlc is None:
        df = df.withColumn("yang_zhang_vol", F.lit(None).cast("double"))
    else:
        o = ohlc if "pos" in ohlc.columns else with_pos(ohlc)
        yz = o.select("symbol", "ts", yang_zhang().alias("_yz"), F.lit(1).alias("_hit"))
        whole = Window.partitionBy("symbol")
        covered = F.count("_hit").over(whole) > 0.9 * F.count(F.lit(1)).over(whole)
        df = df.join(yz, ["symbol", "ts"], "left").withColumn(
            "yang_zhang_vol", F.when(covered, ffill("_yz"))).drop("_yz", "_hit")
    full = fill_dead_columns(lagged(df, FEATURES_V2), FEATURES_V2_ADD)
    return with_pos(complete_cases(full, FEATURES_V2)).select(
        "symbol", "pos", "ts", "close", "r", *FEATURES_V2)


def mixture_inputs(bars: DataFrame, halflife: float = 20.0) -> DataFrame:
    """(r, vol) pairs: vol is the lagged root of a half-life EWM of squared returns."""
    df = with_return(bars.select(*[c for c in ("symbol", "pos", "ts", "close")
                                   if c in bars.columns])).withColumn("_sq", F.col("r") * F.col("r"))
    out = ewm_recursive(df, "_sq", 1 - 2 ** (-1 / halflife), "_var")
    out = out.withColumn("vol", F.lag(F.sqrt("_var")).over(series())).na.drop(subset=["r", "vol"])
    return with_pos(out).select("symbol", "pos", "ts", "close", "r", "vol")


def minmax_normalise(df: DataFrame, columns: dict[str, str], n: int = NORM_WINDOW) -> DataFrame:
    """Adds ``output`` per ``{output: column}``: position inside the trailing range, 0.5 when undefined."""
    src = list(dict.fromkeys(columns.values()))
    ranged = rolling_range(df, src, n, MIN_PERIODS)
    return ranged.selectExpr(*df.columns, *[
        f"CASE WHEN {c}_hi > {c}_lo AND {c} IS NOT NULL THEN "
        f"least(greatest(({c} - {c}_lo) / ({c}_hi - {c}_lo), 0D), 1D) ELSE 0.5D END AS {o}" for o, c in columns.items()])


def rolling_vol(df: DataFrame, n: int = 21, min_periods: int = 5) -> DataFrame:
    """Fallback volatility (back- then forward-filled) and the lagged n-bar forecast."""
    out = df.withColumns({"_v": rolling(F.stddev_samp, "r", n, min_periods),
                          "_f": rolling(F.stddev_samp, "r", n)})
    w = series()
    back = F.first("_v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return out.withColumns({
        "vol_fallback": F.coalesce(back, F.last("_v", ignorenulls=True).over(w.rowsBetween(UNB, 0))),
        "vol_rolling": F.lag("_f").over(w)}).drop("_v", "_f")


def lookback_sequences(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """Sliding n-bar tensors: an array of n feature vectors ending at each bar."""
    frame = series().rowsBetween(-(n - 1), 0)
    return (df.withColumn("sequence", F.collect_list(F.array(*columns)).over(frame))
            .where(F.size("sequence") == n).select("symbol", F.col("pos").alias("end_pos"), "ts", "sequence"))
