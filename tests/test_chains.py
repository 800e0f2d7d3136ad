"""Block scans and block-wise estimation against plain loops."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.models import chains as ch
from barline.models import filters as flt
from barline.models import mixture as mix


def plain_forward(log_emit, trans, start):
    out, ll, p = [], 0.0, None
    for row in log_emit:
        a = (start if p is None else p @ trans) * np.exp(row - row.max())
        ll += math.log(a.sum()) + row.max()
        p = a / a.sum()
        out.append(p)
    return np.array(out), ll


def plain_smooth(filt, trans):
    post, pairs = filt.copy(), np.zeros(trans.shape)
    for t in range(len(filt) - 2, -1, -1):
        flow = filt[t][:, None] * trans * (post[t + 1] / (filt[t] @ trans))[None]
        pairs += flow
        post[t] = flow.sum(axis=1)
    return post, pairs


def plain_path(log_emit, trans, start):
    score, back = np.log(start) + log_emit[0], []
    for row in log_emit[1:]:
        via = score[:, None] + np.log(trans)
        back.append(via.argmax(axis=0))
        score = via.max(axis=0) + row
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def plain_fit(kind, chains, theta, rounds=2000, tolerance=1e-9):
    """Expectation maximisation with a step per row; chains share the parameters."""
    p, last = ch.unpack(kind, np.array(theta)), -np.inf
    for _ in range(rounds):
        sums, pairs, opening, ll = 0, 0, 0, 0
        for x in chains:
            e = ch.log_density(kind, p, x)
            filt, part = plain_forward(e, p["trans"], p["start"])
            post, moved = plain_smooth(filt, p["trans"])
            phi = np.stack([np.ones(len(x)), x[:, 0], x[:, 1], x[:, 0] ** 2, x[:, 0] * x[:, 1], x[:, 1] ** 2], axis=1)
            sums, pairs, opening, ll = sums + post.T @ phi, pairs + moved, opening + post[0], ll + part
        if abs(ll - last) < tolerance:
            return p, ll
        last = ll
        p = ch.unpack(kind, ch.pack(kind, ch.updated(kind, p, sums, pairs, opening)))
    return p, ll


def simulated(rng, n, k=3, stay=0.97):
    state, out, states = 0, [], []
    for _ in range(n):
        state = state if rng.random() < stay else int(rng.integers(k))
        states.append(state)
        out.append([rng.normal(0.001 * (1 - state), 0.004 * (1 + 1.5 * state)), abs(rng.normal(0.004 * (1 + 1.5 * state), 0.002 * (1 + state)))])
    return np.array(out), np.array(states)


def series(spark, parts, **more):
    frames = [pd.DataFrame({"symbol": s, "pos": np.arange(len(x), dtype="int32"), "r": x[:, 0], "vol": x[:, 1], **{k: v(x) for k, v in more.items()}})
              for s, x in parts.items()]
    return spark.createDataFrame(pd.concat(frames)).repartition(3)


def test_products_are_prefix_and_suffix_products():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 37, 64):
        g = rng.random((n, 3, 3)) * 10.0 ** rng.integers(-60, 60, (n, 1, 1))
        ahead, la = ch.products(g)
        rest, lr = ch.products(g, back=True)
        m, logs = np.eye(3), 0.0
        for t in range(n):
            m = m @ g[t]
            logs, m = logs + math.log(m.max()), m / m.max()
            np.testing.assert_allclose(ahead[t], m, rtol=1e-9)
            np.testing.assert_allclose(la[t], logs, rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(rest[0], ahead[-1], rtol=1e-9)
        np.testing.assert_allclose(lr[0], la[-1], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
@pytest.mark.parametrize("kind", [ch.GAUSSIAN, ch.SWITCHING])
def test_block_sums_are_the_smoothed_sums(kind, size):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    k = 2 if kind == ch.SWITCHING else 3
    parts = {"trans": rng.dirichlet(np.ones(k) * 2, k), "start": rng.dirichlet(np.ones(k))}
    parts |= ({"mu": np.array([-0.5, 0.8]), "s2": np.array([0.4, 2.0]), "phi": 0.3} if kind == ch.SWITCHING else
              {"means": rng.normal(size=(k, 2)), "covs": np.array([np.eye(2) * (1 + j) + 0.2 for j in range(k)])})
    p = ch.unpack(kind, ch.pack(kind, parts))
    filt, ll = plain_forward(ch.log_density(kind, p, x), p["trans"], p["start"])
    post, moved = plain_smooth(filt, p["trans"])
    blocks = [ch.expected(x[at:at + size], kind, p, at == 0) for at in range(0, len(x), size)]
    got = ch.weighed(blocks, p["start"])
    phi = np.stack([np.ones(len(x)), x[:, 0], x[:, 1], x[:, 0] ** 2, x[:, 0] * x[:, 1], x[:, 1] ** 2], axis=1)
    assert got[0] == pytest.approx(ll, abs=1e-8)
    np.testing.assert_allclose(got[1], post.T @ phi, rtol=1e-8, atol=1e-8)
    np.testing.assert_allclose(got[2], moved, rtol=1e-8, atol=1e-8)
    np.testing.assert_allclose(got[3], post[0], rtol=1e-8, atol=1e-10)


def test_filter_and_path_of_given_densities_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ch, "BLOCK", 64)
    rng = np.random.default_rng(5)
    trans, start = np.array([[0.9, 0.08, 0.02], [0.1, 0.8, 0.1], [0.0, 0.3, 0.7]]), np.array([0.2, 0.5, 0.3])
    rows, want = [], {}
    for s, n in (("A", 1000), ("B", 64), ("C", 1)):
        e = rng.normal(0, 3, (n, 3)) - rng.choice([0, 800], (n, 1))
        safe = np.maximum(trans, 1e-300)
        want[s] = plain_forward(e, trans, start)[0], plain_path(e, safe, start)
        rows += [(s, 3 * t, e[t].tolist()) for t in range(n)]
    df = spark.createDataFrame(rows, "symbol string, pos int, log_emit array<double>").repartition(3)
    blocks = ch.blocks_of(df.select(F.col("symbol").alias("model"), F.col("symbol").alias("chain"), "pos", F.col("log_emit")[0].alias("e")), ["e"], 64)
    assert blocks.where("chain = 'A'").count() > 40
    p = flt.hmm_forward_filter(df, trans.tolist(), start.tolist()).toPandas().sort_values("pos")
    path = flt.likeliest_path(df, trans.tolist(), start.tolist()).toPandas().sort_values("pos")
    for s, (filt, states) in want.items():
        np.testing.assert_allclose(np.stack(p[p.symbol == s].probs), filt, atol=1e-9)
        assert path[path.symbol == s].state.tolist() == states


@pytest.mark.parametrize("local", [64, 0])
def test_mixture_reaches_the_plain_likelihood_and_recovers_states(spark, monkeypatch, local):
    """All rounds in a task, and a job for each round."""
    monkeypatch.setattr(ch, "LOCAL_BLOCKS", local)
    rng = np.random.default_rng(8)
    parts = {f"S{i}": simulated(rng, (900 if local else 400) + 50 * i) for i in range(3 if local else 2)}
    df = series(spark, {s: x for s, (x, _) in parts.items()}).select(F.col("symbol").alias("model"), F.col("symbol").alias("chain"), "pos", "r", "vol")
    blocks_of = ch.blocks_of
    monkeypatch.setattr(ch, "blocks_of", lambda rows, x, size=128: blocks_of(rows, x, size))
    fit = {r.model: r for r in mix.fit_mixture(df, df.select("model").distinct().withColumn("k", F.lit(3)), 400, 1e-9).collect()}
    for s, (x, states) in parts.items():
        r = fit[s]
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        _, ll = plain_fit(ch.GAUSSIAN, [z], r.theta, tolerance=1e-10)  # from there on a plain loop finds no better point
        ll -= len(x) * np.log(x.std(axis=0)).sum()
        assert r.done and r.log_likelihood == pytest.approx(ll, abs=1e-6)
        covs = ch.unpack(ch.GAUSSIAN, r.theta)["covs"][:, 1, 1]
        assert (np.diff(covs) > 0).all()
    if not local:
        return
    got = mix.regime_mixture(series(spark, {s: x for s, (x, _) in parts.items()}), path=True).toPandas().sort_values(["symbol", "pos"])
    for s, (x, states) in parts.items():
        mine = got[got.symbol == s]
        np.testing.assert_allclose(mine[["p_0", "p_1", "p_2"]].sum(axis=1), 1, atol=1e-9)
        assert (mine.state.to_numpy() == states).mean() > 0.8 and (mine.label.to_numpy() == states).mean() > 0.7


def test_plain_rounds_and_accelerated_rounds_end_alike(spark):
    """From the same start, with the same stopping rule; accelerated rounds are fewer."""
    rng = np.random.default_rng(9)
    v = np.zeros(800)
    state = 0
    for t in range(1, 800):
        state = state if rng.random() < 0.96 else 1 - state
        v[t] = 0.2 * v[t - 1] + rng.normal(0, (0.5, 2.0)[state])
    x = np.stack([v[1:], v[:-1]], axis=1)
    rows = spark.createDataFrame(pd.DataFrame({"model": "a", "chain": "a", "pos": np.arange(len(x)), "v": x[:, 0], "before": x[:, 1]}))
    got = mix.fit_switching(rows, tolerance=1e-9).first()
    z = (x - x[:, 0].mean()) / x[:, 0].std()
    start = ch.pack(ch.SWITCHING, {"mu": np.zeros(2), "s2": np.array([0.5, 2.0]), "phi": 0.0, "start": np.array([0.5, 0.5]),
                                   "trans": np.array([[0.95, 0.05], [0.05, 0.95]])})
    p, ll = plain_fit(ch.SWITCHING, [z], start)
    assert got.log_likelihood == pytest.approx(ll - len(x) * math.log(x[:, 0].std()), abs=1e-5)
    q = ch.unpack(ch.SWITCHING, got.theta)
    assert q["phi"] == pytest.approx(p["phi"], abs=1e-3) and abs(q["phi"] - 0.2) < 0.1
    assert np.sqrt(q["s2"]) * x[:, 0].std() == pytest.approx([0.5, 2.0], rel=0.15)


def test_shared_models_and_gaps(spark):
    """Pooled series, and training rows with a hole: the sums of the chains decide."""
    rng = np.random.default_rng(10)
    parts = {f"S{i}": simulated(rng, 150)[0] for i in range(4)}
    df = series(spark, parts)
    rows = df.select(F.lit("all").alias("model"), F.col("symbol").alias("chain"), "pos", "r", "vol")
    fit = mix.fit_mixture(rows, rows.select("model").distinct().withColumn("k", F.lit(2)), 400, 1e-9, pooled=True).first()
    x = np.concatenate(list(parts.values()))
    z = {s: (v - x.mean(axis=0)) / x.std(axis=0) for s, v in parts.items()}
    _, ll = plain_fit(ch.GAUSSIAN, list(z.values()), fit.theta, tolerance=1e-10)
    assert fit.log_likelihood == pytest.approx(ll - len(x) * np.log(x.std(axis=0)).sum(), abs=1e-6)
    assert mix.regime_mixture(df, k=2, pooled=True).count() == len(x)

    one = {"S0": simulated(rng, 700)[0]}
    hole = series(spark, one, is_train=lambda v: (np.arange(len(v)) < 300) | (np.arange(len(v)) >= 420))
    assert mix.regime_mixture(hole, k=2, train_only=True).count() == 700
    pieces = mix._pieces(hole.where("is_train").select(F.col("symbol").alias("model"), "pos"))
    assert sorted(r["count"] for r in pieces.groupBy("chain").count().collect()) == [280, 300]


def test_short_and_constant_series(spark):
    rng = np.random.default_rng(12)
    x, flat = simulated(rng, 300)[0], np.zeros((150, 2))
    got = mix.regime_mixture(series(spark, {"long": x, "short": x[:50], "flat": flat}))
    count = {r.symbol: r["count"] for r in got.groupBy("symbol").count().collect()}
    assert count["long"] == 300 and "short" not in count
    sw = mix.switching_ar(series(spark, {"long": x, "short": x[:30], "flat": flat}, is_train=lambda v: np.arange(len(v)) < 0.7 * len(v)))
    rows = sw.toPandas()
    assert len(rows) == 480 and np.allclose(rows.p_low + rows.p_high, 1)
    assert (rows[rows.symbol == "short"].p_low == 0.5).all()
    empty = series(spark, {"a": x}).limit(0)
    assert mix.regime_mixture(empty).count() == 0


def test_select_k_counts_parameters_and_picks_the_least_bic(spark):
    rng = np.random.default_rng(13)
    out = mix.select_k(series(spark, {s: simulated(rng, 600)[0] for s in "AB"}), (2, 3)).toPandas()
    assert len(out) == 4 and (out.n_params == [{2: 1 + 2 + 4 + 6, 3: 2 + 6 + 6 + 9}[k] for k in out.k]).all()
    for _, g in out.groupby("symbol"):
        assert (g.best_k == g.k[g.bic.idxmin()]).all()
