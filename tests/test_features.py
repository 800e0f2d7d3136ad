import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.functions.frame import rolling
from barline.functions import scan
from barline.functions.scan import ewm, rolling_range
from barline.operators import features as feat


def series(df, symbol, column):
    pdf = df.where(F.col("symbol") == symbol).orderBy("pos").select(column).toPandas()
    return pdf[column].astype(float)


def test_ewm_matches_pandas_with_gaps_and_small_blocks(bars, closes):
    df = feat.with_return(bars).withColumn("r", F.when(F.col("pos") % 17 != 5, F.col("r")))
    out = ewm(df, {"a": ("r", 0.15), "b": ("r", 0.005)}, block=64).persist()
    r = np.log(closes[closes.symbol == "AA"].close).diff().reset_index(drop=True)
    r[r.index % 17 == 5] = np.nan
    for name, alpha in (("a", 0.15), ("b", 0.005)):
        e = r.ewm(alpha=alpha, min_periods=20)
        np.testing.assert_allclose(series(out, "AA", f"{name}_mean"), e.mean(), rtol=1e-9, equal_nan=True)
        np.testing.assert_allclose(series(out, "AA", f"{name}_std"), e.std(), rtol=1e-8, equal_nan=True)


def test_rolling_range_equals_a_sliding_frame(bars):
    df = bars.withColumn("x", F.when(F.col("pos") % 11 != 3, F.col("close")))
    out = rolling_range(df, ["x"], 37, 20).withColumns({
        "lo2": rolling(F.min, "x", 37, 20), "hi2": rolling(F.max, "x", 37, 20)})
    assert out.where("NOT (x_lo <=> lo2) OR NOT (x_hi <=> hi2)").count() == 0


def test_price_features_match_pandas(bars, closes):
    out = feat.features_v1(bars).persist()
    c = closes[closes.symbol == "BB"].close.reset_index(drop=True)
    r = np.log(c).diff()
    want = {"mom_252": r.rolling(252).sum().shift(1), "autocorr_63": r.rolling(63).corr(r.shift(1)).shift(1),
            "drawdown_252": (c / c.rolling(252, min_periods=20).max() - 1).shift(1),
            "trend_dir": (c.rolling(21).mean() / c.rolling(63).mean() - 1).shift(1)}
    n = out.where("symbol = 'BB'").count()
    assert n == len(c) - 253
    for k, v in want.items():
        np.testing.assert_allclose(series(out, "BB", k), v.iloc[-n:], rtol=1e-7, atol=1e-10)


def test_features_do_not_look_ahead(bars):
    from barline.plans.validation import lookahead_check
    op = lambda df: feat.lagged(feat.drawdown(feat.momentum(feat.with_return(df.select("symbol", "pos", "ts", "close")))),
                                ["mom_20", "drawdown_252"])
    peek = lambda df: df.withColumn("mom_20", F.lead("close").over(feat.series()))
    assert lookahead_check(bars, op, "mom_20", ["close"], n_samples=4).where("NOT passed").count() == 0
    assert lookahead_check(bars, peek, "mom_20", ["close"], n_samples=4).where("passed").count() == 0


def test_bars_must_be_daily(spark):
    df = spark.sql("SELECT 'A' AS symbol, timestamp'2020-01-01 10:00:00' AS ts, 1.0D AS close")
    with pytest.raises(TypeError):
        feat.with_return(df)


def test_features_shuffle_a_series_once(spark):
    rows = spark.range(3).selectExpr("CAST(id AS STRING) AS symbol", "0 AS pos", "DATE'2020-01-01' AS ts", "1D AS close")
    plan = feat.features_v1(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_rolling_blocks_equal_a_plain_window(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=200), rng.normal(size=200) + 1e6
    x[40:60], y[100:120] = 0.1, 7.0  # constant windows
    x[rng.choice(200, 6, replace=False)] = np.nan
    rows = [("A", i, None if np.isnan(a) else float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    got = scan.rolling_blocks(spark.createDataFrame(rows, "symbol string, pos int, x double, y double").repartition(3), 9,
                              {"mean": "x"}, {"corr": ("x", "y")}).orderBy("pos").toPandas()
    px, py = pd.Series(x), pd.Series(y)
    for i in range(200):
        a, b = px[max(0, i - 8):i + 1], py[max(0, i - 8):i + 1]
        whole = len(a) == 9 and a.notna().all()
        assert np.isnan(got["mean"][i]) if not whole else abs(got["mean"][i] - a.mean()) < 1e-12
        varies = whole and a.nunique() > 1 and b.nunique() > 1
        assert np.isnan(got["corr"][i]) if not varies else abs(got["corr"][i] - np.corrcoef(a, b)[0, 1]) < 1e-8


def test_linear_scan_carries_over_many_blocks_and_gaps(spark):
    pos = [p for p in range(50) if p not in (3, 4, 9)]
    df = spark.createDataFrame([("A", p, float(p % 7)) for p in pos], "symbol string, pos int, u double").repartition(3)
    got = {r.pos: r.y for r in scan.linear_scan(df, {"y": ("u", 0.9)}, block=5).collect()}
    want = {t: sum(0.9 ** (t - p) * (p % 7) for p in pos if p <= t) for t in pos}
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in pos)
