import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.functions.scan import block_length, linear_scan
from barline.functions.store import stored
from barline.models.classifier import WINDOW, ConformalState
from barline.operators import alerts, drift

SUBS = "subscriber_id string, email string, webhook_url string, tickers array<string>, notify_consensus boolean"


@pytest.fixture(scope="module")
def subs(spark):
    return spark.createDataFrame([
        ("a", "a@x", None, ["AA"], True), ("b", None, "h1", ["AA", "BB"], False), ("c", None, "h2", None, False),
        ("d", "d@x", "h3", ["*", "AA"], True), ("e", "a@x", None, ["ZZ"], False), ("f", "f@x", None, ["BB", "AA"], None)], SUBS)


@pytest.fixture(scope="module")
def changes(spark):
    return spark.createDataFrame([("AA", "Bull", "Bear"), ("BB", "Neutral", "Bull"), ("CC", "Bear", "Bull"), ("DD", "Bull", "Neutral")],
                                 "symbol string, from_regime string, to_regime string")


def no_change(spark):
    return spark.createDataFrame([], "from_regime string, from_level string, to_regime string, to_level string")


def test_webhook_only_subscribers_are_heard(spark, subs, changes):
    got = {r.subscriber_id: r for r in alerts.match_subscribers(subs, changes).collect()}
    assert {k: r.n_changes for k, r in got.items()} == {"a": 1, "b": 2, "c": 4, "d": 4, "f": 2}
    assert got["b"].digest_id == got["f"].digest_id == "AA,BB" and got["c"].symbols == ["AA", "BB", "CC"]
    messages = alerts.outbox(subs, changes, no_change(spark), "2020-01-01")
    assert alerts.dispatch_counts(subs, messages).first().asDict() == {"sent": 6, "skipped": 1}
    told = spark.createDataFrame([("Bull", "strong", "Bear", "split")], no_change(spark).schema)
    messages = alerts.outbox(subs, changes, told, "2020-01-01")
    assert {r.subscriber_id for r in messages.collect()} == set("abcdf")
    bodies = {(r.digest_id, r.with_consensus): r.body for r in alerts.bodies(messages, subs, changes, told, "2020-01-01").collect()}
    assert len(bodies) == 5 and "Market Consensus: Bull (strong) → Bear (split)" in bodies["*", True]
    assert bodies["*", False].count("•") == 4 and "Market" not in bodies["*", False]


def test_matching_needs_no_product(subs, changes):
    plan = alerts.match_subscribers(subs, changes)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_changes_and_no_subscribers(spark, subs, changes):
    assert alerts.match_subscribers(subs, changes.limit(0)).count() == 0
    assert alerts.match_subscribers(subs.limit(0), changes).count() == 0
    assert alerts.outbox(subs, changes.limit(0), no_change(spark), "x").count() == 0


def test_conformal_buffer_is_the_plain_quantile():
    rng, s, plain, rate = np.random.default_rng(1), ConformalState(), [], 0.1
    for _ in range(900):
        p, y = rng.dirichlet([2, 1, 1]), int(rng.integers(3))
        q = float(np.quantile(plain[-WINDOW:], 1 - rate)) if len(plain) >= 30 else 1.0
        inside, _ = s.step(p, y)
        np.testing.assert_array_equal(inside, 1 - p <= q + 1e-15)
        rate = min(max(rate + 0.005 * (0.1 if inside[y] else -0.9), 1e-6), 1 - 1e-6)
        plain.append(float(1 - p[y]))
        assert abs(s.rate - rate) < 1e-12 and len(s.ordered) <= WINDOW


def test_kernel_discrepancy_of_whole_tables(spark):
    rng = np.random.default_rng(2)

    def frame(x):
        return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "v": x.tolist()}))
    x, y, z = (rng.normal(m, 1, (1500, 8)) for m in (0, 0, 1))
    near, far = (drift.mmd_rbf(frame(x), frame(b), "v", "id", dim=8).first()[0] for b in (y, z))
    scale = drift.median_distance(frame(x), "v", "id", buckets=8)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert abs(scale - np.median(d[d > 0])) < 0.1 * scale

    def exact(a, b):
        def k(u, v):
            return np.exp(-((u[:, None] - v[None]) ** 2).sum(2) / scale).mean()
        return k(a, a) + k(b, b) - 2 * k(a, b)
    assert near < 0.02 and abs(far - exact(x, z)) < 0.05


def test_blocks_follow_beta(spark):
    assert block_length([0.9]) == 1024 and block_length([0.5]) < 1024 and 0.01 ** -block_length([0.01]) < float("inf")
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "pos": np.arange(300), "x": np.ones(300)}))
    y = linear_scan(df, {"y": ("x", 0.01)}).orderBy("pos").toPandas()["y"]
    np.testing.assert_allclose(y.iloc[5:], 1 / 0.99, rtol=1e-9)
    with pytest.raises(Exception):
        linear_scan(df.withColumn("b", F.lit(1e-6)), {"y": ("x", "b")}).collect()


def test_stored_tables_keep_their_rows(spark):
    assert stored(spark.range(5)).count() == 5


def test_fourier_sums_hold_a_slice_at_a_time():
    rng = np.random.default_rng(3)
    w, b = rng.normal(size=(8, 512)), rng.uniform(0, 6, 512)
    pdf = pd.DataFrame({"side": np.arange(20_000) % 2, "v": list(rng.normal(size=(20_000, 8)))})
    tracemalloc.start()
    out = pd.concat(drift.fourier_sums(iter([pdf, pdf.iloc[:10]]), w, b))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6  # all features of the batch at once take 82 MB and more
    for side in (0, 1):
        x = np.array([v for p in (pdf, pdf.iloc[:10]) for v in p[p.side == side].v])
        one = out[out.side == side]
        assert len(one) == 512 and (one.n == len(x)).all()
        assert np.allclose(one.z, (np.cos(x @ w + b) * np.sqrt(2 / 512)).sum(0))
