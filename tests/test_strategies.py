"""Strategies that fit on each path's train rows, conditional variance by refinement, publication, lags over ranges."""

import math
import random
import threading
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.functions.ranged import lag_by_range
from barline.models import volatility as vol
from barline.operators.stats import deflated_sharpe
from barline.plans import strategies as st
from barline.plans import validation as val
from barline.sources import publication as pub


def simulated_garch(rng, n, omega, alpha, beta):
    s2, out = omega / (1 - alpha - beta), []
    for _ in range(n):
        x = rng.normal() * math.sqrt(s2)
        out.append(x / 100)
        s2 = omega + alpha * x * x + beta * s2
    return np.array(out)


def plain_likelihood(r, alpha, beta):
    x = 100 * r
    var = x.var()
    s2, ll = var, 0.0
    for v in x:
        ll -= 0.5 * (math.log(2 * math.pi * s2) + v * v / s2)
        s2 = var * (1 - alpha - beta) + alpha * v * v + beta * s2
    return ll


def test_refined_garch_is_the_best_of_a_fine_grid_and_recovers_parameters(spark):
    rng = np.random.default_rng(21)
    known = {"A": (0.08, 0.88), "B": (0.15, 0.70)}
    parts = {s: simulated_garch(rng, 5000, 0.04, *p) for s, p in known.items()}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"symbol": s, "pos": np.arange(len(r)), "r": r}) for s, r in parts.items()]))
    short = spark.createDataFrame([("C", 0, 0.1), ("C", 1, 0.2)], "symbol string, pos bigint, r double")
    fit = {f.symbol: f for f in vol.fit_garch(df.unionByName(short)).collect()}
    assert set(fit) == {"A", "B"}
    for s, r in parts.items():
        a, b, ll = fit[s].alpha, fit[s].beta, fit[s].ll
        assert ll == pytest.approx(plain_likelihood(r, a, b), rel=1e-9)
        near = max(plain_likelihood(r, a + i * 0.002, b + j * 0.002) for i in (-1, 0, 1) for j in (-1, 0, 1))
        assert near <= ll + 2e-3
        assert a + b == pytest.approx(sum(known[s]), rel=0.05) and a == pytest.approx(known[s][0], abs=0.025)


def test_paths_of_a_series_keep_their_own_variance(spark):
    rng, parts = np.random.default_rng(4), []
    for path, (alpha, beta) in enumerate([(0.05, 0.90), (0.20, 0.55), (0.10, 0.80)]):
        r = simulated_garch(rng, 400, 0.04, alpha, beta)
        parts.append(pd.DataFrame({"symbol": "A", "path_id": path, "pos": np.arange(400), "r": r, "is_train": np.arange(400) < 300}))
    rows = spark.createDataFrame(pd.concat(parts)).repartition(3)
    keys = ("symbol", "path_id")
    got = vol.garch_sigma(rows, keys).toPandas()
    fit = {f.path_id: f for f in vol.fit_garch(rows.where("is_train"), keys, reach=1).collect()}
    assert len(got) == 1200 and len(fit) == 3
    for path, part in enumerate(parts):
        f, want = fit[path], []
        s2 = f.last_sigma2
        for x in 100 * part.r:
            want.append(math.sqrt(s2) / 100)
            s2 = f.omega + f.alpha * x * x + f.beta * s2
        np.testing.assert_allclose(got[got.path_id == path].sort_values("pos").sigma, want, rtol=1e-6)


def test_deflated_sharpe_of_returns_next_to_nothing(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0.001, 0.01, 100)
    parts = [pd.DataFrame({"symbol": f"{v:g}", "ret": x * v}) for v in (1.0, 1e-20, 1e-40, 1e-60, 1e-80, 1e-120)]
    parts.append(pd.DataFrame({"symbol": "near", "ret": 1e-28 * (1 + np.arange(100) % 2 * 2e-16)}))
    out = {r.symbol: (r.dsr_p_value, r.dsr_sharpe) for r in deflated_sharpe(spark.createDataFrame(pd.concat(parts)), ["symbol"]).collect()}
    assert out["1e-20"] == pytest.approx(out["1"], rel=1e-9) and out["1"][1] > 0
    assert out["near"][1] > 0 and all(out[k] == (0.0, 0.0) for k in ("1e-40", "1e-60", "1e-80", "1e-120"))


def view_of(spark, n=900, seed=3):
    """Two series on two paths with a purged hole, as the fold view has them."""
    rng, rows = np.random.default_rng(seed), []
    for s in "AB":
        state, vols = 0, []
        for _ in range(n):
            state = state if rng.random() < 0.98 else 1 - state
            vols.append((0.004, 0.02)[state])
        r = rng.normal(0, vols)
        f = pd.DataFrame({"symbol": s, "pos": np.arange(n), "r": r, "wild": np.array(vols) > 0.01})
        f["vol_ewma"] = pd.Series(r).abs().ewm(alpha=0.1).mean()
        for path, (a, b) in enumerate([(0, n // 3), (n // 2, n // 2 + n // 3)]):
            role = np.where((f.pos >= a) & (f.pos < b), "test", np.where((f.pos >= b) & (f.pos < b + 15), "dropped", "train"))
            rows.append(f.assign(path_id=path, role=role))
    out = spark.createDataFrame(pd.concat(rows)).withColumn("rule_label", F.when(F.col("wild"), 2).otherwise(0))
    return out.where("role <> 'dropped'").withColumn("path_id", F.col("path_id").cast("int"))


def test_states_of_the_test_rows_come_from_the_train_rows(spark):
    view = view_of(spark).persist()
    p = st.switching_probabilities(view).join(view, ["symbol", "path_id", "pos"]).where("role = 'test'").toPandas()
    assert len(p) == 1200 and ((p.p_high > 0.5) == p.wild).mean() > 0.85
    # Other test rows change no model: what the train rows give a path doesn't depend on returns of its test rows to come.
    changed = view.withColumn("r", F.when((F.col("role") == "test") & (F.col("pos") % 300 >= 150), F.col("r") * 7).otherwise(F.col("r")))
    a, b = [st.switching_probabilities(v).join(view.select("symbol", "path_id", "pos", "role"), ["symbol", "path_id", "pos"]).where(
        "path_id = 0 AND pos < 150").orderBy("symbol", "pos").toPandas() for v in (view, changed)]
    np.testing.assert_allclose(a.p_high, b.p_high, atol=1e-9)


def test_every_fitted_strategy_gives_one_position_per_row(spark):
    view = view_of(spark, 450).persist()
    want = {tuple(r) for r in view.select("symbol", "path_id", "role", "pos").collect()}
    found = {"switching": st.allocated(st.switching_probabilities, ["p_low", "p_high"], (1.0, -0.3), 1),
             "hmm": st.allocated(st.mixture_probabilities(3), ["p_0", "p_1", "p_2"], (1.0, 0.0, -0.5), 0),
             "fusion": st.allocated(st.fusion_probabilities(), ["fusion_p0", "fusion_p1", "fusion_p2"], (1.0, 0.0, -0.5), 1),
             "garch": st.garch_target()}
    for name, strategy in found.items():
        out = strategy(view).toPandas()
        assert {tuple(r) for r in out[["symbol", "path_id", "role", "pos"]].itertuples(index=False)} == want, name
        assert len(out) == len(want) and out.position.between(-0.5, 1.0).all() and out.position.std() > 0.01, name
    p = st.change_probabilities(view, ["vol_ewma", "r"])
    assert p.count() == len(want) and p.where("p_change < 0 OR p_change > 1").count() == 0 and p.select("p_change").distinct().count() > 10


def test_strategies_run_side_by_side_and_share_a_fit(spark, monkeypatch):
    rng, met, fits = np.random.default_rng(6), threading.Barrier(2, timeout=60), []
    frame = spark.createDataFrame(pd.DataFrame({"symbol": "A", "pos": np.arange(60), "r": rng.normal(0, 0.01, 60), "horizon": 1}))
    monkeypatch.setattr(st, "stored", lambda df: df)

    def fit(view):
        time.sleep(0.2)
        fits.append(view)
        return view
    shared = st.once(fit)

    def strategy(position):
        def run(view):
            met.wait()  # nobody comes if one strategy has to end before the next begins
            return shared(view).select(*val.CELL, F.lit(position).alias("position"))
        return run
    cells = val.panel_cells(frame, {"b": strategy(0.5), "a": strategy(-0.5)}, risk=False, n_splits=3, n_test=1)
    got = {tuple(r) for r in cells.select("strategy", "strategy_idx", "position").distinct().collect()}
    assert len(fits) == 1 and got == {("b", 0, 0.5), ("a", 1, -0.5)}


@pytest.mark.parametrize("stop", ["data", "manifest", "pointer", None])
def test_publication_survives_a_stop_between_any_two_steps(spark, tmp_path, stop):
    path, schema = f"file://{tmp_path}/p", "symbol string, label int"
    yes, no = [spark.createDataFrame([(v,)], "publish boolean") for v in (True, False)]

    def frame(day, label):
        return spark.createDataFrame([("A", label), ("B", label)], schema)

    def seen():
        return [sorted(map(tuple, pub.published(spark, path, schema, w).select("symbol", "label", F.col("generated_at").cast("string")).collect()))
                for w in ("current", "previous")]
    rows = {d: [("A", k, d), ("B", k, d)] for k, d in enumerate(("2024-01-01", "2024-02-01", "2024-03-01"))}
    assert seen() == [[], []]
    for k, day in enumerate(list(rows)[:2]):
        assert pub.publish(frame(day, k), yes, path, day)
    before = [rows["2024-02-01"], rows["2024-01-01"]]
    assert seen() == before and not pub.publish(frame("2024-03-01", 2), no, path, "2024-03-01") and seen() == before

    class Stop(Exception):
        pass

    def between(step):
        if step == stop:
            raise Stop
    if stop:
        with pytest.raises(Stop):
            pub.publish(frame("2024-03-01", 2), yes, path, "2024-03-01", between)
        assert seen() == ([rows["2024-03-01"], rows["2024-02-01"]] if stop == "pointer" else before)
    for _ in range(2):  # the job run again, and once more
        assert pub.publish(frame("2024-03-01", 2), yes, path, "2024-03-01")
        assert seen() == [rows["2024-03-01"], rows["2024-02-01"]]


def test_lag_over_ranges_is_the_plain_lag(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), t, rng.choice([None, 1.5, 2.5])) for t in range(600)]
    df = spark.createDataFrame(rows, "symbol string, ts int, x double").repartition(9)
    got = sorted(((r.symbol or "", r.ts, r.x, r.p) for r in lag_by_range(df, ["symbol"], ["ts"], {"p": "x"}).collect()), key=lambda r: r[1])
    last, want = {}, []
    for s, t, x in rows:
        want.append((s or "", t, x, last.get(s)))
        last[s] = x
    assert got == want
    whole = sorted((r.ts, r.p) for r in lag_by_range(df, [], ["ts"], {"p": "ts"}).collect())
    assert whole == [(t, t - 1 if t else None) for t in range(600)]
    assert lag_by_range(df.limit(0), ["symbol"], ["ts"], {"p": "x"}).count() == 0
