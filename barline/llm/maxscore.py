"""Exact top-k inner products by MaxScore over signed integer vectors.

Terms are (dimension, sign): the posting list of a term holds the vectors whose component has that sign, with its
magnitude. For a query the terms of its own signs add to a score, all others only lower it, so the sum of a set of
terms' bounds (query weight times the largest magnitude of the list) bounds what they add. Per shard and query, terms
are put in order of their bounds; the longest run of small ones whose bounds add up to less than the k-th best score
known is non-essential: a vector in no essential list can't enter. Essential lists are traversed into accumulators, in
chunks of vectors with the chunk's own bounds; the rest of the terms is probed one by one, the largest bound first, for
vectors that are still competitive; what is left is scored exactly. Shards' lists merge by score, then vec_id.

Vectors are dealt to shards and queries to blocks by hash. Each shard's posting lists are built once and written to the
shared folder, as are the blocks; a task takes one block through a group of shards, reading one shard at a time. The k-th
best score found passes from shard to shard, and every query starts with that of a first pass over the ``SEEDS`` longest
vectors, so most lists are non-essential from the first shard on. No vector is shuffled more than once, and a task
holds one shard and one block whatever the table's size.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, written
from .tokenfile import put

K, SCALE, EVERY = 5, 256, 50
BLOCK_QUERIES, SHARD_VECTORS, CHUNK, SEEDS = 512, 1 << 14, 4096, 1024
#: Tasks that a search is cut into where its blocks are fewer, and partitions of the table of tasks at most.
TASKS, MOST_TASKS = 64, 100_000
#: Scores beyond this can't be added in 64-bit integers.
SAFE = 1 << 62


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component x as double; rows that take no part are left out."""
    x = F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad).select(
        "vec_id", x.alias("v"))


def _matrix(vectors, dims: int, dtype) -> np.ndarray:
    out = np.zeros((len(vectors), dims), dtype=dtype)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


class Postings:
    """The posting lists of one chunk of vectors: per (dimension, sign) the rows and magnitudes.

    A list of more than an eighth of the chunk's rows is kept as one magnitude for each row, 0 where it has none.
    """

    def __init__(self, x: np.ndarray):
        self.x, self.columns = x, np.ascontiguousarray(x.T)
        self.rows, self.values, self.most = [], [], []
        for sign in (1, -1):
            rows, values = [], []
            for column in self.columns:
                own = np.flatnonzero(sign * column > 0)
                dense = 8 * len(own) > len(x)
                rows.append(None if dense else own)
                values.append(np.maximum(sign * column, 0) if dense else np.abs(column[own]))
            self.rows.append(rows)
            self.values.append(values)
            self.most.append(np.array([v.max() if len(v) else 0 for v in values], dtype=x.dtype))

    def top(self, q: np.ndarray, floor, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the k best with a score of at least ``floor`` (None: unknown), and their scores."""
        positive = q > 0
        bound = np.where(positive, q * self.most[0], -q * self.most[1])
        order = np.argsort(bound, kind="stable")
        total = np.cumsum(bound[order])
        cut = 0 if floor is None else int(np.searchsorted(total, floor, side="left"))
        acc = np.zeros(len(self.x), dtype=self.x.dtype)
        for d in order[cut:][::-1]:  # essential lists
            side = 0 if positive[d] else 1
            rows = self.rows[side][d]
            if rows is None:
                acc += abs(q[d]) * self.values[side][d]
            else:
                acc[rows] += abs(q[d]) * self.values[side][d]
        # With some list left out the floor is positive, and a vector in any essential list has a positive sum.
        alive = np.flatnonzero(acc > 0) if cut else np.arange(len(self.x))
        for at in range(cut - 1, -1, -1):  # probes, while competitive
            alive = alive[acc[alive] + total[at] >= floor]
            d = order[at]
            acc[alive] += np.maximum(q[d] * self.columns[d][alive], 0)
        if floor is not None:
            alive = alive[acc[alive] >= floor]
        score = self.x[alive] @ q
        return (alive, score) if floor is None else (alive[score >= floor], score[score >= floor])


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _whole(vectors: list, dims: int) -> np.ndarray:
    x = _matrix(vectors, dims, np.int64)
    return x.astype(object) if float(np.abs(x.astype(float)).max(initial=0)) ** 2 * dims >= SAFE else x


def _read(path: str):
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_stream(name) as f:
        return pickle.loads(f.read())


def write_shard(pdf: pd.DataFrame, path: str, dims: int) -> pd.DataFrame:
    """A shard's vectors with their posting lists, in chunks."""
    shard, x, ids = int(pdf["shard"].iloc[0]), _whole(pdf["v"].tolist(), dims), pdf["vec_id"].to_numpy()
    chunks = [(ids[at:at + CHUNK], Postings(x[at:at + CHUNK])) for at in range(0, len(x), CHUNK)]
    put(f"{path}/shard-{shard:07d}", pickle.dumps(chunks))
    return pd.DataFrame({"part": [shard], "n": [len(pdf)]})


def write_block(pdf: pd.DataFrame, path: str, dims: int, seeds: tuple, k: int) -> pd.DataFrame:
    """A block of queries, each with the k-th best score among the seeds (None where there are fewer)."""
    block, q = int(pdf["block"].iloc[0]), _whole(pdf["v"].tolist(), dims)
    ids, x = np.array(seeds[0], dtype=np.int64), _whole(seeds[1], dims)
    floors = []
    for query_id, row in zip(pdf["vec_id"], q):
        scores = np.sort((x.astype(object) if row.dtype == object else x)[ids != query_id] @ row)
        floors.append(scores[-k] if len(scores) >= k else None)
    put(f"{path}/block-{block:07d}", pickle.dumps((pdf["query"].tolist(), pdf["vec_id"].to_numpy(), q, floors)))
    return pd.DataFrame({"part": [block], "n": [len(pdf)]})


def search(path: str, block: int, shards: list[int], k: int):
    """The k best of a group of shards for each query of a block: (query, query_id, vec_id, score)."""
    queries, query_ids, q, floors = _read(f"{path}/block-{block:07d}")
    best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=q.dtype)) for _ in queries]
    for shard in shards:
        for own, postings in _read(f"{path}/shard-{shard:07d}"):
            for i, row in enumerate(q):
                x = postings if postings.x.dtype == q.dtype else Postings(postings.x.astype(object))
                rows, scores = x.top(row, floors[i], k)
                other = own[rows] != query_ids[i]
                best[i] = _best(np.concatenate([best[i][0], own[rows][other]]), np.concatenate([best[i][1], scores[other]]), k)
                if len(best[i][1]) == k and (floors[i] is None or best[i][1][-1] > floors[i]):
                    floors[i] = best[i][1][-1]
    return [(name, int(query_ids[i]), int(v), max(-(1 << 63), min((1 << 63) - 1, int(s))))
            for i, name in enumerate(queries) for v, s in zip(*best[i])]


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row whose vec_id is divisible by ``every``.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without a vec_id. Rows that
    repeat both vec_id and vector count once; rows that share a vec_id but not the vector are candidates of their own, but
    not for one another, and queries of their own with a list each. Shorter vectors count as padded with zeros. Ties go to
    the smaller vec_id; with fewer candidates all are returned. Scores beyond 64 bits are clamped. An empty table gives no
    rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    v = written(quantised(vectors, scale).distinct(), "vectors")
    asked = v.where(F.pmod("vec_id", F.lit(every)) == 0)
    n, dims = v.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    m, dims = asked.count(), max(dims or 1, 1)
    shards, blocks = max(1, -(-n // SHARD_VECTORS)), max(1, -(-m // BLOCK_QUERIES))
    norm = F.aggregate("v", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c.cast("double"))
    longest = v.orderBy(F.desc(norm), "vec_id", "v").limit(SEEDS).collect()  # a fixed number
    seeds = [r.vec_id for r in longest], [r.v for r in longest]
    path, h = fresh_path(spark, "postings"), F.xxhash64("vec_id", "v")
    made = [written(df, "parts").count() for df in (
        v.withColumn("shard", F.pmod(h, F.lit(shards))).groupBy("shard").applyInPandas(
            lambda pdf: write_shard(pdf, path, dims), "part bigint, n bigint"),
        asked.withColumn("query", h).withColumn("block", F.pmod(F.xxhash64(F.lit("q"), "vec_id", "v"), F.lit(blocks))).groupBy(
            "block").applyInPandas(lambda pdf: write_block(pdf, path, dims, seeds, k), "part bigint, n bigint"))]
    groups = min(shards, max(1, -(-TASKS // blocks)))
    tasks = spark.range(blocks * groups, numPartitions=max(1, min(blocks * groups, MOST_TASKS)))

    def run(batches):
        for pdf in batches:
            for i in pdf["id"]:
                found = search(path, int(i) // groups, list(range(int(i) % groups, shards, groups)), k)
                yield pd.DataFrame(found, columns=["query", "query_id", "vec_id", "score"]).astype("int64")
    if not made[1]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    found = tasks.mapInPandas(run, "query bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB twin of ``top_k`` with its defaults.
SQL = f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.e, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, e
  ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
