"""Exact nearest centroids by Orchard search, and Lloyd rounds on whole numbers.

Each centroid has the list of all others in ascending order of their distance from it. A vector starts at a centroid and
walks its list; whenever a listed centroid is nearer to the vector (or as near, with a smaller number), the walk jumps to
that one's list. Centroids measured once are marked and skipped. A walk ends when the next on the list lies strictly
beyond twice the current distance: by the triangle inequality nothing from there on can be nearer or as near. All walks
of a block of vectors advance together.

Distances are squares of whole numbers, so "twice the distance" is "four times the square" and every comparison, sum
and quotient is exact. A round reads the vectors once; each task hands on one row of sums for each centroid it met, and
only the centroids reach the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

K, ROUNDS, SCALE, DIMS, SEED = 16, 3, 64, 64, "1"
#: Vectors that walk together; a block holds this many rows of marks, one mark for each centroid.
BLOCK = 4096
#: Components beyond this would let a squared distance overflow 64 bits.
LARGEST = 1 << 26


@dataclass
class Lists:
    """Centroids (k x dims), the neighbour list of each, and the squared distances in the order of the lists."""

    centres: np.ndarray
    order: np.ndarray
    apart: np.ndarray

    @classmethod
    def of(cls, centres: np.ndarray) -> "Lists":
        apart = np.stack([((centres - c) ** 2).sum(axis=1) for c in centres])
        order = np.argsort(apart, axis=1, kind="stable")
        # The centroid itself leaves its list; a twin at distance 0 may stand before it.
        order = np.stack([o[o != i] for i, o in enumerate(order)])
        return cls(centres, order, np.take_along_axis(apart, order, axis=1))

    def nearest(self, x: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Per vector the nearest centroid (ties: the smaller number) and the squared distance; and distances measured."""
        n, k = len(x), len(self.centres)
        here = np.zeros(n, dtype=np.int64) if start is None else start.copy()
        best = ((x - self.centres[here]) ** 2).sum(axis=1)
        seen = np.zeros((n, k), dtype=bool)
        seen[np.arange(n), here] = True
        at, walking, measured = np.zeros(n, dtype=np.int64), np.arange(n), n
        while len(walking):
            walking = walking[at[walking] < k - 1]
            spot = here[walking], at[walking]
            within = self.apart[spot] <= 4 * best[walking]
            walking, other = walking[within], self.order[spot][within]
            at[walking] += 1
            new = ~seen[walking, other]
            w, o = walking[new], other[new]
            seen[w, o] = True
            d = ((x[w] - self.centres[o]) ** 2).sum(axis=1)
            measured += len(w)
            nearer = (d < best[w]) | (d == best[w]) & (o < here[w])
            w, o = w[nearer], o[nearer]
            best[w], here[w], at[w] = d[nearer], o, 0
        return here, best, measured


def usable(df: DataFrame, dims: int = DIMS) -> DataFrame:
    """(vec_id, embedding) of vectors with exactly ``dims`` components, none null, NaN or infinite."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.select(F.col("vec_id").cast("bigint"), "embedding").where((F.size(x) == dims) & finite)


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    x = np.floor(scale * x.astype(np.float64))
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"a scaled component lies beyond {LARGEST}: its squared distance needs more than 64 bits")
    return x.astype(np.int64)


def _blocks(batches, scale: int):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            column = part.column(part.schema.get_field_index("embedding"))
            yield part, _whole(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1), scale)


def first_centres(vectors: DataFrame, k: int, scale: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of seed, colon and vec_id (ties: the smaller vector; null ids last)."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = (vectors.select(key.alias("key"), "embedding").orderBy(F.col("key").asc_nulls_last(), "embedding").limit(k)
            .select("embedding").collect())
    return _whole(np.array([r.embedding for r in rows], dtype=np.float64), scale)


def moved(vectors: DataFrame, lists: Lists, scale: int) -> np.ndarray:
    """The centroids after one round: exact floors of the means; those without vectors stay."""
    k, dims = lists.centres.shape

    def run(batches):
        total, count = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for _, x in _blocks(batches, scale):
            here, _, _ = lists.nearest(x)
            np.add.at(total, here, x)
            count += np.bincount(here, minlength=k)
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(count[met], pa.int64()),
                                          pa.array(total[met].tolist(), pa.list_(pa.int64()))],
                                         names=["cluster", "n", "sums"])
    parts = vectors.mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    sums = (parts.select("cluster", F.posexplode("sums").alias("dim", "s"), "n").groupBy("cluster", "dim")
            .agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
    centres = lists.centres.copy()
    for r in sums.collect():  # k x dims rows
        centres[r.cluster, r.dim] = r.s // r.n
    return centres


def assigned(vectors: DataFrame, lists: Lists, scale: int) -> DataFrame:
    """(vec_id, cluster, distance) per vector, the distance squared."""
    def run(batches):
        for part, x in _blocks(batches, scale):
            here, best, _ = lists.nearest(x)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("vec_id")),
                                              pa.array(here, pa.int32()), pa.array(best, pa.int64())],
                                             names=["vec_id", "cluster", "distance"])
    return vectors.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, seed: str = SEED) -> np.ndarray:
    """Centroids of usable vectors after the rounds; fewer than ``k`` vectors give as many centroids, none give none."""
    centres = first_centres(vectors, k, scale, seed)
    for _ in range(rounds if len(centres) else 0):
        centres = moved(vectors, Lists.of(centres), scale)
    return centres


def clustered(df: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 per usable vector.

    Vectors that are null, of another length, or hold null, NaN or infinite components take no part. A null vec_id or one
    that repeats keeps its rows; null ids seed a centroid only if there are too few others. Vectors as near to two
    centroids go to the smaller number; equal centroids may stand beside each other, all but the first are empty. An
    empty table gives no rows. A component of more than 2^26 after scaling raises an error. Other columns are not read.
    """
    spark, vectors = df.sparkSession, usable(df, dims)
    centres = fit(vectors, k, rounds, scale, seed)
    schema = "vec_id bigint, cluster int, distance bigint"
    if not len(centres):
        rows, tables = spark.createDataFrame([], schema), []
    else:
        rows = written(assigned(vectors, Lists.of(centres), scale), "assigned")
        sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
        tables = [(i, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centres[i].tolist())).encode()).hexdigest())
                  for i, s in sums.items()]
    per = spark.createDataFrame(tables, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(per), "cluster").select(  # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    near = ("SELECT i, arg_min(k, {{'d': d, 'k': k}}) AS k, min(d) AS d FROM (SELECT v.i, c.k, list_sum(list_transform("
            "range(1, {dims} + 1), lambda j: (v.x[j] - c.x[j]) * (v.x[j] - c.x[j]))) AS d FROM v, {c} c) GROUP BY i")
    mean = ("SELECT k, list(m ORDER BY j) AS x FROM (SELECT k, j, CASE WHEN s - (s // n) * n < 0 THEN s // n - 1 ELSE s // n END "
            "AS m FROM (SELECT a.k, j, CAST(sum(v.x[j]) AS BIGINT) AS s, count(*) AS n FROM {a} a JOIN v USING (i), "
            "range(1, {dims} + 1) r(j) GROUP BY a.k, j)) GROUP BY k "
            "UNION ALL SELECT k, x FROM {c} WHERE k NOT IN (SELECT k FROM {a})")
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS ({near.format(dims=DIMS, c=f'c{r}')})")
        if r < ROUNDS:
            steps.append(f"c{r + 1} AS ({mean.format(dims=DIMS, a=f'a{r}', c=f'c{r}')})")
    return f"""
WITH v AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, x) - 1 AS k, x FROM v
  QUALIFY k < {K}),
{", ".join(steps)}
SELECT v.vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (i) JOIN c{ROUNDS} c USING (k)"""


#: DuckDB twin of ``clustered`` with its default parameters.
SQL = _sql()
