"""SimHash and MaxScore against brute force."""

import math
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from barline.llm import maxscore, simhash


def plain_fingerprint(text):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = data.split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(fps):
    fps = list(fps)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_golay_blocks_cover_exactly():
    every, weight, start, syndrome = simhash._golay()
    near = weight <= simhash.RADIUS
    assert near.sum() == 2048 and len(np.unique(syndrome(every[near]))) == 2048


def test_linked_fingerprints_share_an_anchor():
    rng = random.Random(1)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.randint(0, 2)):
            b ^= 1 << k
        own = simhash.anchors(a, own=True)
        assert len(own) == 1 and own[0] in simhash.anchors(b) and own[0] in simhash.anchors(a)


def test_components_match_brute_force(docs, rows, no_docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fp = {simhash._signed(f): f for f in {plain_fingerprint(r[1]) for r in rows}}
    assert {r.fp for r in got} == set(fp)
    root = plain_components(fp.values())
    first = {}
    for d, t, *_ in rows:
        c = root[plain_fingerprint(t)]
        first[c] = min([x for x in (first.get(c), d) if x is not None], default=None)
    assert all(r.component_id == first[root[fp[r.fp]]] for r in got)
    assert simhash.near_duplicates(no_docs).collect() == []
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    left = [root[plain_fingerprint(r.text)] for r in kept.collect()]
    assert sorted(left) == sorted(set(first))
    assert simhash.keep_first(no_docs).count() == 0


def test_no_side_of_the_anchor_join_is_broadcast(spark):
    rng = random.Random(3)
    fps = [simhash._signed(rng.getrandbits(64)) for _ in range(200)]
    found = simhash.links(spark.createDataFrame([(f,) for f in fps + [fps[0] ^ 5]], "fp bigint"))
    assert [{*r} for r in found.collect()] == [{fps[0], fps[0] ^ 5}]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_chains_join_in_one_component(spark):
    rng = random.Random(2)
    chain, x = [], rng.getrandbits(64)
    for _ in range(40):
        chain.append(x)
        for k in rng.sample(range(64), 2):
            x ^= 1 << k
    far = [rng.getrandbits(64) for _ in range(200)]
    df = spark.createDataFrame([(simhash._signed(f),) for f in {*chain, *far}], "fp bigint")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    want = plain_components({*chain, *far})
    groups = {}
    for f, r in want.items():
        groups.setdefault(r, set()).add(f)
    found = {}
    for n, r in roots.items():
        found.setdefault(r, set()).add(n & (1 << 64) - 1)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_fingerprint_of_short_texts():
    for t in (None, "", " \n", "One", "one TWO", "é É", "a b c d a b c"):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def plain_top(rows, every, k, scale=256):
    vectors = set()
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        vectors.add((i, tuple(math.floor(scale * x) for x in v)))
    out = []
    for i, q in vectors:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def check(spark, rows, every=7, k=5):
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows],
                               "vec_id bigint, embedding array<double>, rank int, shard int").repartition(3)
    got = sorted(map(tuple, maxscore.top_k(df, every=every, k=k).collect()))
    assert got == plain_top(rows, every, k)


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=16) * (rng.random(16) < .6)).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[7 * i][1]) for i in range(60)]  # ties
    rows += [(2001, None), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [float("inf")] + [0.0] * 15),
             (2100, [0.5, -0.5]), (2107, []), (None, [1.0] * 16), rows[3], (14, [0.25] * 16), (-7, [-1.0] * 16)]
    check(spark, rows)


def test_repeated_ids_and_many_shards_and_blocks(spark, monkeypatch):
    """Rows that share an id but not the vector are all candidates; thresholds pass between shards and from the seeds."""
    for name, value in (("SHARD_VECTORS", 64), ("BLOCK_QUERIES", 5), ("CHUNK", 16), ("SEEDS", 12), ("TASKS", 8)):
        monkeypatch.setattr(maxscore, name, value)
    rng = np.random.default_rng(6)
    rows = [(i % 300, (rng.normal(size=8) * (rng.random(8) < .7)).tolist()) for i in range(420)]
    rows += [rows[0], rows[0], (0, rows[5][1]), (14, rows[28][1])]
    check(spark, rows)
    check(spark, [(7, [1.0, 2.0]), (7, [3.0, -1.0]), (8, [1.0])])
    check(spark, rows[:6], every=1000)


def test_top_k_over_many_chunks_and_large_values(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 12))
    check(spark, [(i, (centre[i % 6] + rng.normal(size=12) * .1).tolist()) for i in range(5000)], every=500)
    check(spark, [(i, (rng.normal(size=3) * 2.0 ** 21).tolist()) for i in range(40)])
    check(spark, [(0, [1.0]), (7, [2.0])])
    check(spark, [])
    assert maxscore.quantised(spark.createDataFrame([(1, [0.999, -0.001])], "vec_id bigint, embedding array<float>")
                              ).select(F.col("v")).first()[0] == [255, -1]


def test_pruning_never_loses_a_best_vector():
    rng = np.random.default_rng(5)
    x = rng.integers(-40, 40, (2000, 20))
    x[:, 10:] *= rng.random((2000, 10)) < .1
    for _ in range(50):
        q = rng.integers(-40, 40, 20)
        floor = np.sort(x @ q)[-5]
        rows, scores = maxscore.Postings(x).top(q, floor, 5)
        assert sorted(rows) == np.flatnonzero(x @ q >= floor).tolist() and (scores == (x @ q)[rows]).all()
