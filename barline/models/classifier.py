"""Boosted-tree classifiers, blends and conformal sets."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, col
from ..functions.store import stored
from . import boosting as bo

CLASSES = (-1, 0, 1)
PROBABILITIES = ("q_down", "q_flat", "q_up")
# The small tuning grid.
SMALL_GRID = {"max_depth": [3, 5], "eta": [0.05], "n_estimators": [100, 200]}


def _one(model: str = "all") -> Column:
    return F.lit(model).alias("model")


class BarrierClassifier:
    """A weighted boosted model of the three labels in {-1, 0, 1}, with class probabilities.

    A label absent from training keeps probability 0; a single label falls back to the prior.
    """

    def __init__(self, features: Sequence[str], max_depth: int = bo.DEPTH, eta: float = bo.ETA, n_estimators: int = bo.ROUNDS,
                 seed: int = bo.SEED):
        self.features, self.seed = list(features), seed
        self.max_depth, self.eta, self.n_estimators = max_depth, eta, n_estimators
        self.edges: list[list[float]] = []
        self.models: DataFrame | None = None

    def fit(self, df: DataFrame, label: str = "label", weight: str = "weight") -> "BarrierClassifier":
        self.edges = bo.bin_edges(df, self.features)
        rows = bo.binned(df.select(*self.features, (F.col(label) + 1).cast("int").alias("y"), F.col(weight).cast("double").alias("w")),
                         self.features, self.edges).where("y IS NOT NULL AND w > 0")
        self.models = bo.fit_models(rows.select(_one(), "bins", "y", "w"), len(CLASSES), rounds=self.n_estimators,
                                    depth=self.max_depth, eta=self.eta, seed=self.seed)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds q_down, q_flat, q_up and position = q_up - q_down; no rows without training rows."""
        rows = bo.binned(df, self.features, self.edges).withColumn("model", F.lit("all"))
        q = F.col("_q")[0]
        out = bo.predict(rows, self.models, len(CLASSES), (self.n_estimators,), "_q")
        return out.select(*df.columns, *[q[i].alias(n) for i, n in enumerate(PROBABILITIES)]).withColumn("position", signed_position())

    def importance(self) -> list[tuple[str, float]]:
        """Share of the gain by feature name, largest first."""
        rows = self.models.select("gains").collect()  # one row
        if not rows or not sum(rows[0].gains):
            return []
        return sorted(((f, g / sum(rows[0].gains)) for f, g in zip(self.features, rows[0].gains)), key=lambda x: -x[1])


def signed_position(up: str = "q_up", down: str = "q_down") -> Column:
    return F.col(up) - F.col(down)


def tune(split: DataFrame, features: Sequence[str], grid: dict[str, list] = SMALL_GRID, label: str = "label",
         weight: str = "weight") -> DataFrame:
    """(max_depth, eta, n_estimators, log_loss, folds): mean held-out loss per grid point over purged inner folds.

    ``split`` has role train or test per path_id. All folds, depths and rates are fitted in one job; points that differ in
    the number of trees are read off the same trees.
    """
    stages = sorted(set(grid["n_estimators"]))
    rows = split.where("role IN ('train', 'test')").select(
        F.col("path_id").cast("string").alias("path"), "role", (F.col(label) + 1).cast("int").alias("y"),
        F.col(weight).cast("double").alias("w"), *features).where("y IS NOT NULL")
    rows = stored(bo.binned(rows, features, bo.bin_edges(split, features)).select("path", "role", "y", "w", "bins"))
    points = F.inline(F.array(*[F.struct(F.lit(d).alias("depth"), F.lit(e).alias("eta")) for d, e in product(grid["max_depth"], grid["eta"])]))
    models = stored(rows.select(F.col("path").alias("source")).distinct().select("source", points).withColumn(
        "model", F.concat_ws("|", "source", F.col("depth").cast("string"), F.col("eta").cast("string"))))
    train = rows.where("role = 'train' AND w > 0").select(F.col("path").alias("model"), "bins", "y", "w")
    fits = bo.fit_models(train, len(CLASSES), models, rounds=stages[-1])
    test = rows.where("role = 'test'").join(models, rows.path == models.source).select("model", "bins", "y", "depth", "eta", "path")
    q = bo.predict(test, fits, len(CLASSES), stages).select("depth", "eta", "path", "y", F.posexplode("q").alias("stage", "q"))
    loss = -F.ln(F.greatest(F.element_at("q", F.col("y") + 1), F.lit(1e-15)))
    per = q.groupBy("depth", "eta", "path", "stage").agg(F.avg(loss).alias("loss"))
    trees = F.element_at(F.array(*map(F.lit, stages)), F.col("stage") + 1)
    return per.groupBy("depth", "eta", "stage").agg(F.avg("loss").alias("log_loss"), F.count(F.lit(1)).alias("folds")).select(
        F.col("depth").alias("max_depth"), "eta", trees.alias("n_estimators"), "log_loss", "folds")


class TransitionDetector:
    """Chance of a regime change within the horizon: boosted trees, rare class up-weighted."""

    def __init__(self, features: Sequence[str], max_depth: int = bo.DEPTH, eta: float = bo.ETA, n_estimators: int = bo.ROUNDS,
                 seed: int = bo.SEED):
        self.features, self.params = list(features), dict(depth=max_depth, eta=eta, rounds=n_estimators, seed=seed)
        self.models, self.edges, self.pos_weight = None, [], None

    def fit(self, df: DataFrame) -> "TransitionDetector":
        """``df`` has target and in_fit. Under 30 rows or one class, predictions stay at 0.5."""
        rows = df.where("in_fit")
        n, pos = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("target"), F.lit(0))).first()
        if n < 30 or pos in (0, n):
            return self
        self.pos_weight = float(np.clip((n - pos) / pos, 1.0, 50.0))
        self.edges = bo.bin_edges(rows, self.features)
        weighted = bo.binned(rows.select(*self.features, F.col("target").cast("int").alias("y"), F.when(
            F.col("target") == 1, self.pos_weight).otherwise(1.0).alias("w")), self.features, self.edges)
        self.models = bo.fit_models(weighted.select(_one(), "bins", "y", "w"), 2, **self.params)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if self.models is None:
            return df.withColumn("p_change", F.lit(0.5))
        rows = bo.binned(df, self.features, self.edges).withColumn("model", F.lit("all"))
        out = bo.predict(rows, self.models, 2, (self.params["rounds"],), "_q")
        return out.select(*df.columns, F.col("_q")[0][1].alias("p_change"))


def equal_blend(positions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of base positions, clipped to one unit either way."""
    return positions.groupBy(*keys).agg(clip(F.avg("position"), -1.0, 1.0).alias("position"))


def ridge_blend(wide: DataFrame, strategies: Sequence[str], keys: Sequence[str], alpha: float = 1.0, non_negative: bool = False,
                scale: float = 100.0, min_rows: int = 30) -> DataFrame:
    """Blend positions by a ridge of returns on base positions, fitted on role = 'train'.

    The Gram matrix of each key is one Spark aggregate; only its k x k result is solved in Python.
    Keys with too few rows use the equal blend. Output: keys, pos, role, position.
    """
    k = len(strategies)
    ok = F.col("r").isNotNull()
    for s in strategies:
        ok = ok & F.col(s).isNotNull()
    train = wide.where((F.col("role") == "train") & ok)
    sums = [F.sum(s).alias(f"s_{i}") for i, s in enumerate(strategies)]
    sums += [F.sum(F.col(s) * F.col("r")).alias(f"y_{i}") for i, s in enumerate(strategies)]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"g_{i}_{j}") for i, a in enumerate(strategies) for j, b in enumerate(strategies) if j >= i]
    gram = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("sy"), *sums)

    def solve(batches):
        for pdf in batches:
            rows = []
            for _, m in pdf.iterrows():
                if m["n"] < min_rows:
                    rows.append((None, None))
                    continue
                sx, xy = np.array([m[f"s_{i}"] for i in range(k)]), np.array([m[f"y_{i}"] for i in range(k)])
                g = np.array([[m[f"g_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                a = g - np.outer(sx, sx) / m["n"] + alpha * np.eye(k)
                b = xy - sx * m["sy"] / m["n"]
                w = np.linalg.solve(a, b)
                if non_negative:
                    w = np.maximum(w, 0.0)
                    for _ in range(500):  # coordinate descent on the k x k problem
                        for i in range(k):
                            w[i] = max(0.0, w[i] + (b[i] - a[i] @ w) / a[i, i])
                rows.append((w.tolist(), float((m["sy"] - sx @ w) / m["n"])))
            yield pdf[list(keys)].assign(coefs=[r[0] for r in rows], intercept=[r[1] for r in rows])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wide.select(*keys).schema.fields)
    coefs = gram.mapInPandas(solve, f"{types}, coefs array<double>, intercept double")
    joined = wide.join(coefs, list(keys), "left")
    score = sum((F.get("coefs", F.lit(i)) * F.col(s) for i, s in enumerate(strategies)), F.col("intercept")) * scale
    mean = sum((F.col(s) for s in strategies[1:]), F.col(strategies[0])) / k
    blended = F.when(F.col("coefs").isNull(), mean).otherwise(F.coalesce(score, F.lit(0.0)))
    return joined.select(*keys, "pos", "role", clip(blended, -1.0, 1.0).alias("position"))


ALPHA, GAMMA, WINDOW, MIN_SCORES, RATE_EDGE = 0.10, 0.005, 500, 30, 1e-6


def rank_value(ordered: list[float], share: float) -> float:
    """Value at a share of the ranks of an ordered list, between neighbours by interpolation."""
    at = share * (len(ordered) - 1)
    low = int(at)
    step = ordered[min(low + 1, len(ordered) - 1)] - ordered[low]
    return ordered[low] + step * (at - low)


def confined(p: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Probabilities of the set's members, adding up to one; unchanged where the set has no mass."""
    members = p * inside
    return members / members.sum() if members.sum() > 0 else p.copy()


class ConformalState:
    """The newest scores of one series, in order of arrival and of size, and its miscoverage rate."""

    def __init__(self, scores=(), rate: float = ALPHA):
        self.arrived = deque(scores)
        self.ordered = sorted(self.arrived)
        self.rate = rate

    @property
    def scores(self) -> list[float]:
        return list(self.arrived)

    def threshold(self) -> float:
        return rank_value(self.ordered, 1 - self.rate) if len(self.ordered) >= MIN_SCORES else 1.0

    def learn(self, score: float, covered: bool) -> None:
        """Insert a score, evict the oldest beyond the window, and move the rate towards its target."""
        self.arrived.append(score)
        insort(self.ordered, score)
        if len(self.arrived) > WINDOW:
            del self.ordered[bisect_left(self.ordered, self.arrived.popleft())]
        drift = GAMMA * (ALPHA if covered else ALPHA - 1)
        self.rate = min(max(self.rate + drift, RATE_EDGE), 1 - RATE_EDGE)

    def step(self, p: np.ndarray, y: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Prediction set and calibrated vector for p; learns from y when it is known."""
        inside = 1 - p <= self.threshold()
        if y is not None and 0 <= y < len(p):
            self.learn(float(1 - p[y]), bool(inside[y]))
        return inside, confined(p, inside)


CONFORMAL = "symbol string, pos int, c_0 double, c_1 double, c_2 double, set_size int, covered boolean, rate double"


def adaptive_conformal(df: DataFrame, probs: Sequence[str], target: str, learn: str | None = None) -> DataFrame:
    """Online conformal sets per series; a recursion over one daily series at a time.

    ``learn`` names a boolean column: rows where it is false are predicted with frozen state.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        state, rows = ConformalState(), []
        for p, y, on in zip(pdf[["a", "b", "c"]].to_numpy(dtype=float), pdf["y"], pdf["learn"]):
            known = None if pd.isna(y) else int(y)
            inside, cal = state.step(p, known if on else None)
            rows.append((*cal, int(inside.sum()), None if known is None else bool(inside[known]), state.rate))
        out = pd.DataFrame(rows, columns=["c_0", "c_1", "c_2", "set_size", "covered", "rate"])
        out.insert(0, "symbol", pdf["symbol"].to_numpy())
        out.insert(1, "pos", pdf["pos"].to_numpy())
        return out

    flag = F.lit(True) if learn is None else F.col(learn)
    return df.select("symbol", "pos", *[F.col(p).alias(n) for p, n in zip(probs, "abc")], F.col(target).alias("y"),
                     flag.alias("learn")).groupBy("symbol").applyInPandas(run, CONFORMAL)


def conformal_position(up: str = "c_2", down: str = "c_0") -> Column:
    return col(up) - col(down)


