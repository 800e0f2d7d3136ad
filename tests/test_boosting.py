"""Boosted trees: splits against brute force, staged and keyed fits, classes, weights, missing values, tuning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.models import boosting as bo
from barline.models import classifier as clf


def plain_best_split(x, g, h):
    """(gain, feature, bin, missing left) of the best first split, over all splits one by one."""
    def score(a, b):
        s = np.sign(a) * max(abs(a) - bo.L1, 0)
        return s * s / (b + bo.L2)
    best = (0.0,)
    for f in range(x.shape[1]):
        for at in range(bo.MISSING - 1):
            for missing_left in (True, False):
                go = np.where(x[:, f] == bo.MISSING, missing_left, x[:, f] <= at)
                if h[go].sum() >= bo.LEAST_CHILD and h[~go].sum() >= bo.LEAST_CHILD:
                    gain = score(g[go].sum(), h[go].sum()) + score(g[~go].sum(), h[~go].sum()) - score(g.sum(), h.sum())
                    best = max(best, (gain, f, at, missing_left))
    return best


@pytest.mark.parametrize("seed", range(4))
def test_first_split_is_the_best(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (120, 3)).astype(np.uint8)
    x[rng.random(x.shape) < 0.1] = bo.MISSING
    g, h = rng.normal(size=120) + (x[:, 1] > 5), rng.random(120) + 0.1
    gains = np.zeros(3)
    feature, at, left, values = bo.grow(x, g, h, np.arange(3), 1, gains)
    want = plain_best_split(x, g, h)
    assert gains.sum() == pytest.approx(want[0]) and feature[0] == want[1]
    go = np.where(x[:, feature[0]] == bo.MISSING, left[0], x[:, feature[0]] <= at[0])
    assert np.allclose(bo.leaves(x, (feature, at, left, values)), np.where(go, values[0], values[1]))


def table(spark, n=900, seed=1, models=("a",)):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = np.where((x[:, 0] > 0) ^ (x[:, 1] > 0.3), 1, np.where(x[:, 2] > 0.8, -1, 0))
    f = pd.DataFrame({f"f_{i}": np.where(rng.random(n) < 0.03, np.nan, x[:, i]) for i in range(4)})
    f["label"], f["weight"], f["model"], f["id"] = y, 1.0, [models[i % len(models)] for i in range(n)], np.arange(n)
    return spark.createDataFrame(f).withColumn("label", F.col("label").cast("int"))


FEATURES = [f"f_{i}" for i in range(4)]


def test_classifier_learns_an_interaction_and_names_its_features(spark):
    df = table(spark)
    model = clf.BarrierClassifier(FEATURES, n_estimators=60).fit(df.where("id < 700"))
    out = model.predict(df.where("id >= 700")).toPandas()
    q = out[["q_down", "q_flat", "q_up"]].to_numpy()
    assert np.allclose(q.sum(axis=1), 1) and np.allclose(out.position, out.q_up - out.q_down)
    assert (q.argmax(axis=1) - 1 == out.label).mean() > 0.85
    names = model.importance()
    assert sum(v for _, v in names) == pytest.approx(1) and names[-1][0] == "f_3"


def test_weights_absent_classes_and_single_class(spark):
    df = table(spark)
    two = df.where("label <> -1")
    q = clf.BarrierClassifier(FEATURES, n_estimators=5).fit(two).predict(df).toPandas()
    assert (q.q_down == 0).all() and np.allclose(q.q_flat + q.q_up, 1)
    one = clf.BarrierClassifier(FEATURES, n_estimators=5).fit(df.where("label = 0"))
    q = one.predict(df).toPandas()
    assert (q.q_flat == 1).all() and one.importance() == []
    heavy = clf.BarrierClassifier(FEATURES, n_estimators=20).fit(df.withColumn("weight", F.when(F.col("label") == 1, 50.0).otherwise(1.0)))
    plain = clf.BarrierClassifier(FEATURES, n_estimators=20).fit(df)
    assert heavy.predict(df).agg(F.avg("q_up")).first()[0] > plain.predict(df).agg(F.avg("q_up")).first()[0] + 0.1


def test_models_of_one_job_are_those_fitted_alone(spark):
    df = table(spark, models=("a", "b", "c"))
    edges = bo.bin_edges(df, FEATURES)
    rows = bo.binned(df, FEATURES, edges).select("model", "bins", (F.col("label") + 1).alias("y"), F.col("weight").alias("w"), "id")
    every = {r.model: r for r in bo.fit_models(rows, 3, rounds=8).collect()}
    assert set(every) == {"a", "b", "c"}
    alone = bo.fit_models(rows.where("model = 'b'").repartition(5), 3, rounds=8).first()
    assert alone.trees == every["b"].trees and alone.n == 300
    few = bo.fit_models(rows.where("model = 'b'"), 3, rounds=3)
    staged = bo.predict(rows, bo.fit_models(rows, 3, rounds=8), 3, (3, 8)).where("model = 'b'").orderBy("id").collect()
    direct = bo.predict(rows.where("model = 'b'"), few, 3, (3,)).orderBy("id").collect()
    assert np.allclose([r.q[0] for r in staged], [r.q[0] for r in direct])
    assert not np.allclose([r.q[0] for r in staged], [r.q[1] for r in staged])


def test_bounded_training_rows_are_the_same_whatever_the_partitions(spark):
    df = table(spark)
    rows = bo.binned(df, FEATURES, bo.bin_edges(df, FEATURES)).select(
        "model", "bins", (F.col("label") + 1).alias("y"), F.col("weight").alias("w"))
    a, b = [bo.fit_models(rows.repartition(p), 3, rounds=2, most=200).first() for p in (1, 7)]
    assert a.n == b.n == 200 and a.trees == b.trees


def test_detector_weighs_the_rare_class(spark):
    df = table(spark).withColumns({"target": (F.col("label") == -1).cast("int"), "in_fit": F.col("id") < 700})
    det = clf.TransitionDetector(FEATURES, n_estimators=40).fit(df)
    assert det.pos_weight > 3
    out = det.predict(df.where("id >= 700")).toPandas()
    assert out.p_change[out.target == 1].mean() > out.p_change[out.target == 0].mean() + 0.3
    assert (clf.TransitionDetector(FEATURES).fit(df.where("id < 20")).predict(df).toPandas().p_change == 0.5).all()


def test_tuning_scores_every_point_on_all_folds(spark):
    df = table(spark, 600)
    folds = df.withColumn("path_id", F.explode(F.array(*map(F.lit, range(3))))).withColumn(
        "role", F.when(F.col("id") % 3 == F.col("path_id"), "test").otherwise("train"))
    grid = {"max_depth": [1, 3], "eta": [0.1], "n_estimators": [2, 30]}
    out = {(r.max_depth, r.n_estimators): r for r in clf.tune(folds, FEATURES, grid).collect()}
    assert len(out) == 4 and all(r.folds == 3 and 0 < r.log_loss < 1.2 for r in out.values())
    assert out[3, 30].log_loss < out[1, 30].log_loss and out[3, 30].log_loss < out[3, 2].log_loss
