import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barline.functions.quantiles import exact_quantiles
from barline.models import mixture as mix
from barline.models import volatility as vol
from barline.models.classifier import ConformalState, ridge_blend
from barline.operators.regimes import RegimeState


def test_switching_ar_recovers_volatility_states(spark):
    rng = np.random.default_rng(11)
    state, states = 0, []
    for _ in range(600):
        state = state if rng.random() < 0.97 else 1 - state
        states.append(state)
    r = rng.normal(0, np.where(states, 0.025, 0.005))
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "pos": np.arange(600, dtype="int32"), "r": r, "is_train": np.arange(600) < 420}))
    out = mix.switching_ar(df).orderBy("pos").toPandas()
    np.testing.assert_allclose(out.p_low + out.p_high, 1.0)
    assert ((out.p_high > 0.5).astype(int) == np.array(states)).mean() > 0.9


def test_garch_scan_equals_the_recursion(spark):
    rng = np.random.default_rng(2)
    r = rng.normal(0, 0.01, 700)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "pos": np.arange(700), "r": r, "omega": 0.05, "alpha": 0.1, "beta": 0.8, "sigma2_0": 2.0}))
    got = vol.garch_variance(df).orderBy("pos").toPandas()["sigma2"].to_numpy()
    want = [2.0]
    for x in r[:-1]:
        want.append(0.05 + 0.1 * (100 * x) ** 2 + 0.8 * want[-1])
    np.testing.assert_allclose(got, want, rtol=1e-9)
    fit = vol.fit_garch(df.select("symbol", "pos", "r")).first()
    assert fit["alpha"] + fit["beta"] < 1 and fit["omega"] > 0


def test_remaining_duration_of_an_exponential_is_its_scale(spark):
    got = spark.range(1).select(*[vol.remaining_duration(F.lit(1.0), F.lit(5.0), F.lit(d)).alias(f"d{d}") for d in (0, 3, 20)]).first()
    np.testing.assert_allclose(list(got), [5.0, 5.0, 5.0], rtol=1e-3)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.round(rng.normal(size=4000), 2), np.full(3000, 0.5)])
    df = spark.createDataFrame(pd.DataFrame({"column": "a", "x": x}))
    probs = [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, "x", "column", probs).orderBy("prob").toPandas()["quantile"]
    np.testing.assert_allclose(got, np.quantile(x, probs), rtol=1e-12)


def test_stabiliser_follows_the_older_vote_and_hysteresis():
    s = RegimeState()
    bull, bear = np.array([1.0, 0.0, 0.0]), np.array([0.0, 0.0, 1.0])
    assert s.step(bull, 0.5, 0, 0)[1] == 0
    assert s.step(bear, 0.5, 9, 9)[1] == 0  # two votes differ: the older one counts
    assert s.step(bear, 0.5, 9, 9)[1] == 2


def test_conformal_coverage():
    rng = np.random.default_rng(0)
    s, hits = ConformalState(), 0
    for _ in range(1500):
        p = rng.dirichlet([2, 2, 2])
        y = rng.choice(3, p=p)
        inside, cal = s.step(p, y)
        assert np.isclose(cal.sum(), 1)
        hits += inside[y]
    assert 0.86 < hits / 1500 < 0.95


def test_ridge_blend_matches_the_normal_equations(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 2))
    y = x @ [0.003, -0.001] + rng.normal(0, 0.01, 200)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "path_id": 0, "pos": range(200), "r": y, "a": x[:, 0], "b": x[:, 1],
                                             "role": ["train"] * 150 + ["test"] * 50}))
    got = ridge_blend(df, ["a", "b"], ["symbol", "path_id"]).orderBy("pos").toPandas()["position"]
    t, m = x[:150], x[:150].mean(axis=0)
    w = np.linalg.solve((t - m).T @ (t - m) + np.eye(2), (t - m).T @ y[:150])
    want = np.clip(100 * ((x - m) @ w + y[:150].mean()), -1, 1)
    np.testing.assert_allclose(got, want, rtol=1e-8)
