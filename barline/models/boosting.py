"""Many boosted-tree models at once: features binned once, one task for each model.

All models of a job (folds, depths, universes) are rows of one table keyed by ``model``; Spark deals them to tasks, so a grid
of folds and depths is grown in one pass. A model is fitted on at most ``TRAIN_ROWS`` of its rows, those with the smallest
hashes, which bounds a task whatever the table holds; every other pass (bin edges, predictions, losses) reads all rows.
Predictions at fewer rounds come from the same trees, so points of a grid that differ in rounds alone share a fit.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.store import stored

BINS, TRAIN_ROWS, PART_ROWS, SEED = 64, 100_000, 20_000, 42
MISSING = BINS - 1
# The published settings.
ROUNDS, DEPTH, ETA, ROW_SHARE, COLUMN_SHARE, L2, L1, LEAST_CHILD = 200, 4, 0.05, 0.8, 0.8, 1.0, 0.1, 1.0


def bin_edges(df: DataFrame, features: Sequence[str]) -> list[list[float]]:
    """Cut points of each feature at even ranks, from one bounded sketch per feature."""
    probs = [i / (BINS - 1) for i in range(1, BINS - 1)]
    clean = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features]
    row = df.agg(*[F.percentile_approx(c, probs, 10_000).alias(f"e{i}") for i, c in enumerate(clean)]).first()
    return [sorted(set(e or [])) for e in row]


def binned(df: DataFrame, features: Sequence[str], edges: list[list[float]], out: str = "bins") -> DataFrame:
    """Adds the bin of every feature as a byte, one byte string per row; null and NaN have a bin of their own."""
    cuts = [np.array(e) for e in edges]
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches):
        for batch in batches:
            x = np.empty((batch.num_rows, len(features)), dtype=np.uint8)
            for i, c in enumerate(features):
                v = batch.column(batch.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False)
                x[:, i] = np.where(np.isnan(v), MISSING, np.searchsorted(cuts[i], v, side="right"))
            rows = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], names=[*batch.schema.names, out])
    return df.mapInArrow(run, schema)


def _shrunk(g: np.ndarray) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - L1, 0.0)


def _score(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return _shrunk(g) ** 2 / (h + L2)


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, columns: np.ndarray, depth: int, gains: np.ndarray) -> tuple:
    """One tree on the gradients and curvatures of its rows: (feature, bin, missing goes left) per inner node, leaf values.

    Nodes are those of a full tree, level by level; a node that no split improves sends all rows left.
    """
    node, d = np.zeros(len(x), dtype=np.int64), len(columns)
    feature, at = np.full((1 << depth) - 1, -1), np.zeros((1 << depth) - 1, dtype=np.int64)
    left = np.ones((1 << depth) - 1, dtype=bool)
    flat = x[:, columns].astype(np.int64) + np.arange(d) * BINS
    for level in range(depth):
        n = 1 << level
        cell = (node[:, None] * (d * BINS) + flat).ravel()
        sums = [np.bincount(cell, np.repeat(v, d), n * d * BINS).reshape(n, d, BINS) for v in (g, h)]
        whole = [s[:, :1].sum(axis=2, keepdims=True) for s in sums]
        best = np.zeros(n)
        for missing_left in (True, False):
            gl, hl = [np.cumsum(s[:, :, :MISSING], axis=2) + (s[:, :, MISSING:] if missing_left else 0) for s in sums]
            gr, hr = whole[0] - gl, whole[1] - hl
            gain = _score(gl, hl) + _score(gr, hr) - _score(*whole)
            gain = np.where((hl >= LEAST_CHILD) & (hr >= LEAST_CHILD), gain, 0.0)[:, :, :MISSING - 1].reshape(n, -1)
            pick = gain.argmax(axis=1)
            value = gain[np.arange(n), pick]
            better = value > best + 1e-9
            best = np.where(better, value, best)
            ids = n - 1 + np.flatnonzero(better)
            feature[ids], at[ids], left[ids] = columns[pick[better] // (MISSING - 1)], pick[better] % (MISSING - 1), missing_left
        np.add.at(gains, feature[n - 1:2 * n - 1][best > 0], best[best > 0])
        node = 2 * node + _right(x, feature[n - 1 + node], at[n - 1 + node], left[n - 1 + node])
    sums = [np.bincount(node, v, 1 << depth) for v in (g, h)]
    return feature.astype(np.int16), at.astype(np.uint8), left, -_shrunk(sums[0]) / (sums[1] + L2)


def _right(x: np.ndarray, feature: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Which rows go right at their nodes."""
    v = x[np.arange(len(x)), np.maximum(feature, 0)]
    return (feature >= 0) & np.where(v == MISSING, ~left, v > at)


def leaves(x: np.ndarray, tree: tuple) -> np.ndarray:
    """The leaf value of each row."""
    feature, at, left, values = tree
    node, first = np.zeros(len(x), dtype=np.int64), 0
    while first < len(feature):
        here = first + node
        node = 2 * node + _right(x, feature[here], at[here], left[here])
        first = 2 * first + 1
    return values[node]


def probabilities(margin: np.ndarray) -> np.ndarray:
    """(n, classes): softmax of the margins, or of 0 and the margin where there is one."""
    if margin.shape[1] == 1:
        margin = np.concatenate([np.zeros_like(margin), margin], axis=1)
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, rounds: int = ROUNDS, depth: int = DEPTH, eta: float = ETA,
          seed: int = SEED) -> tuple[list[list[tuple]], np.ndarray]:
    """Trees of each round, one for each class (one in all for two), and the gain of each feature."""
    rng, n, d = np.random.default_rng(seed), *x.shape
    margin = np.zeros((n, classes if classes > 2 else 1))
    target = np.eye(classes)[y][:, -margin.shape[1]:]
    gains, out = np.zeros(d), []
    for _ in range(rounds):
        rows = rng.random(n) < ROW_SHARE
        columns = np.sort(rng.permutation(d)[:max(1, round(COLUMN_SHARE * d))])
        p = probabilities(margin)[:, -margin.shape[1]:]
        g, h = w[:, None] * (p - target), w[:, None] * np.maximum(p * (1 - p), 1e-16) * (2.0 if classes > 2 else 1.0)
        trees = []
        for k in range(margin.shape[1]):
            *splits, values = grow(x[rows], g[rows, k], h[rows, k], columns, depth, gains)
            trees.append((*splits, eta * values))
            margin[:, k] += leaves(x, trees[-1])
        out.append(trees)
    return out, gains


def fit_models(rows: DataFrame, classes: int, settings: DataFrame | None = None, rounds: int = ROUNDS, depth: int = DEPTH,
               eta: float = ETA, seed: int = SEED, most: int = TRAIN_ROWS) -> DataFrame:
    """Rows (model, bins, y, w) to one row per model: (model, n, prior, gains, trees).

    ``settings`` has (model, source, depth, eta): several models may train on the rows of one source. A model whose rows are
    all of one class has no trees; its prior says the rest.
    """
    h = F.xxhash64("bins", "y", "w")
    nth = F.row_number().over(Window.partitionBy("model").orderBy(h))
    kept = rows.select("model", "bins", "y", "w", nth.alias("nth")).where(F.col("nth") <= most).drop("nth")
    if settings is None:
        kept = kept.withColumns({"depth": F.lit(depth), "eta": F.lit(eta)})
    else:
        kept = kept.withColumnRenamed("model", "source").join(settings, "source").drop("source")
    types = pa.schema([("model", pa.string()), ("n", pa.int64()), ("prior", pa.list_(pa.float64())),
                       ("gains", pa.list_(pa.float64())), ("trees", pa.binary())])

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by([("bins", "ascending"), ("y", "ascending"), ("w", "ascending")])  # whatever order rows arrive in
        raw = t["bins"].to_pylist()
        x = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
        y, w = t["y"].to_numpy().astype(np.int64), t["w"].to_numpy()
        count = np.bincount(y, minlength=classes)
        trees, gains = [], np.zeros(x.shape[1])
        if (count > 0).sum() > 1:
            trees, gains = boost(x, y, w, classes, rounds, t["depth"][0].as_py(), t["eta"][0].as_py(), seed)
        return pa.Table.from_arrays([pa.array([v], ty) for v, ty in zip(
            (t["model"][0].as_py(), len(y), count / count.sum(), gains, pickle.dumps(trees)), types.types)], schema=types)
    return stored(kept.groupBy("model").applyInArrow(fit, "model string, n bigint, prior array<double>, gains array<double>, "
                                                     "trees binary"))


def predict(rows: DataFrame, models: DataFrame, classes: int, stages: Sequence[int] = (ROUNDS,), out: str = "q") -> DataFrame:
    """Adds ``q``: for every stage the class probabilities after that many rounds, as an array of arrays.

    ``rows`` has model and bins; rows of models that aren't there are left out. A label that the training rows lack has
    probability 0.
    """
    kept = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.ArrayType(T.DoubleType())))])

    def run(part: pa.Table, fitted: pa.Table) -> pa.Table:
        raw = part["bins"].to_pylist() if fitted.num_rows else []
        x = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
        q = np.zeros((len(raw), len(stages), classes))
        if raw:
            trees, prior = pickle.loads(fitted["trees"][0].as_py()), np.array(fitted["prior"][0].as_py())
            margin = np.zeros((len(raw), classes if classes > 2 else 1))
            for s, stage in enumerate(stages):
                for several in trees[stages[s - 1] if s else 0:stage]:
                    for k, tree in enumerate(several):
                        margin[:, k] += leaves(x, tree)
                p = (probabilities(margin) if trees else np.broadcast_to(prior, (len(raw), classes))) * (prior > 0)
                q[:, s] = p / p.sum(axis=1, keepdims=True)
        return part.slice(0, len(raw)).select(kept).append_column(out, pa.array(q.tolist(), pa.list_(pa.list_(pa.float64()))))
    # A model's rows are cut into parts of bounded size, and its trees travel once to each part.
    parts = rows.groupBy("model").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("_parts"))
    cut = rows.join(parts, "model").withColumn("_part", F.pmod(F.xxhash64(F.struct(*kept)), "_parts").cast("int")).drop("_parts")
    fitted = models.select("model", "prior", "trees").join(parts, "model").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return cut.groupBy("model", "_part").cogroup(fitted.groupBy("model", "_part")).applyInArrow(run, schema)
