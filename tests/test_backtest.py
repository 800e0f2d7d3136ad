from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barline.functions.columns import normal_cdf
from barline.operators import backtest as bt
from barline.operators import features, folds, labels, stats
from barline.plans import validation as val


def test_folds_equal_the_set_definition(spark):
    n, splits, horizon = 203, 5, 7
    df = spark.range(n).select(F.lit("A").alias("symbol"), F.col("id").cast("int").alias("pos"),
                               (F.col("id") % horizon).cast("int").alias("horizon"))
    got = folds.cpcv_split(df, splits, 2, 0.02).toPandas()
    size, embargo = n // splits, int(np.ceil(0.02 * n))
    edges = [(g * size, n if g == splits - 1 else (g + 1) * size) for g in range(splits)]
    for path, groups in enumerate(combinations(range(splits), 2)):
        test = {p for g in groups for p in range(*edges[g])}
        barred = {i for i in range(n) if any(j in test for j in range(i, min(i + i % horizon, n - 1) + 1))}
        barred |= {p for g in groups for p in range(edges[g][1], edges[g][1] + embargo)}
        rows = got[got.path_id == path]
        assert set(rows[rows.role == "test"].pos) == test
        assert set(rows[rows.role == "train"].pos) == set(range(n)) - test - barred
    fast = folds.cpcv_split(df, splits, 2, 0.02, test_only=True)
    assert fast.count() == (got.role == "test").sum()


def test_risk_limits_equal_a_bar_loop(spark):
    rng = np.random.default_rng(3)
    n, r = 400, rng.normal(-0.002, 0.02, 400)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "path_id": 0, "pos": range(n), "r": r,
                                             "role": ["train"] * 150 + ["test"] * 250}))
    got = bt.risk_limits(df).where("role = 'test'").orderBy("pos").toPandas()
    hist, equity, peak, halted = list(r[:150][-60:]), 1.0, 1.0, False
    for t, x in enumerate(r[150:]):
        q = np.quantile(hist, 0.05)
        dd = equity / peak - 1
        if halted and dd > -0.075:
            halted = False
        if not halted and dd < -0.15:
            halted = True
        assert bool(got.halted[t]) == halted
        assert np.isclose(got.var_limit[t], 0.02 / abs(q))
        equity *= 1 + x
        peak = max(peak, equity)
        hist = (hist + [x])[-60:]


def test_normal_cdf_and_deflation(spark):
    xs = [-9.0, -5.0, -3.2, -1.0, 0.0, 0.5, 2.0, 4.9, 6.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(normal_cdf("x")).toPandas().iloc[:, 0]
    np.testing.assert_allclose(got, [NormalDist().cdf(x) for x in xs], rtol=1e-6, atol=1e-15)
    assert stats.expected_max_z(1) == 0.0 and 2.2 < stats.expected_max_z(50) < 2.35


def test_pbo_extremes(spark):
    rows = [(p, s, float(s), float(s)) for p in range(6) for s in range(4)]
    df = spark.createDataFrame(rows, "path_id int, strategy_idx int, is_perf double, oos_perf double").withColumn("symbol", F.lit("A"))
    assert stats.overfitting_probability(df).first()["pbo"] == 0.0
    flipped = df.withColumn("oos_perf", -F.col("oos_perf"))
    assert stats.overfitting_probability(flipped).first()["pbo"] == 1.0


def test_sample_weights_against_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    n = 60
    t1 = np.minimum(np.arange(n) + rng.integers(0, 8, n), n - 1)
    ret = rng.normal(0, 0.01, n)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "pos": range(n), "t1": t1, "ret": ret, "label": 0}))
    got = labels.sample_weights(df).orderBy("pos").toPandas()["weight"]
    cover = [sum(1 for i in range(n) if i <= t <= t1[i]) for t in range(n)]
    w = np.array([np.mean([1 / cover[t] for t in range(i, t1[i] + 1)]) for i in range(n)])
    w = w * np.abs(ret) / np.abs(ret).mean() * np.exp(-(n - 1 - np.arange(n)) / (n - 1))
    np.testing.assert_allclose(got, w / w.mean(), rtol=1e-9)


def test_large_fold_tables_are_joined_with_equal_rows(bars, monkeypatch):
    from barline.operators import folds

    def rows(**kw):
        return sorted(map(tuple, folds.cpcv_split(bars, 6, 2, **kw).select("symbol", "pos", "path_id", "role", "test_groups").collect()))
    small = rows(), rows(test_only=True)
    monkeypatch.setattr(folds, "LITERAL_PATHS", 3)
    assert (rows(), rows(test_only=True)) == small and len(folds.fold_table(24, 5)) == 42504


def test_universe_report_equals_one_by_one_without_shuffling_paths(spark, bars):
    frame = features.features_v1(bars).select("symbol", "pos", "r", "mom_20").persist()
    short = frame.where("pos < 40").withColumn("symbol", F.concat(F.lit("short"), "symbol"))
    position = bt.benchmark_positions()["momentum_20d"]
    got = {r.symbol: r for r in val.evaluate_assets(frame.unionByName(short), "m", position, 10, 5).collect()}
    want = {r.symbol: r for r in val.validate(frame, "m", position, n_splits=5).collect()}
    assert len(got) == 2 * len(want) and all(got[f"short{s}"].error and got[f"short{s}"].n_paths is None for s in want)
    for s, w in want.items():
        assert got[s].error is None
        for k, v in w.asDict().items():
            g = got[s][k] if k != "strategy" else v
            assert g == v or abs(g - v) < 1e-9, k
    cells = val.backtest_cells(frame, {"m": position}, n_splits=5, spread=False)
    assert cells._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0].count("Exchange") == 0
