"""Near-duplicate stage against brute-force Jaccard similarity."""

import random

from pyspark.sql import functions as F

from barline.llm import neardup, simhash


def plain_set(text):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_kept(rows):
    """The smallest id (null last) of each component of links at 0.8, with its text."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        k = find(i)
        first[k] = min(first.get(k, (True, 0)), (d is None, d or 0))
    return sorted(first.values())


def kept(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())


def replaced(rng, words, k):
    words = list(words)
    for i in rng.sample(range(len(words)), k):
        words[i] = f"new{rng.random()}"
    return words


def test_edited_copies_go_as_brute_force_says(spark):
    """Copies with 1 to 12 of 300 words replaced, chains of copies, and copies whose source isn't the smallest id."""
    rng = random.Random(6)
    pool = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for g in range(60):
        base = rng.choices(pool, k=300)
        texts = [base] + [replaced(rng, base, rng.randint(1, 12)) for _ in range(rng.randint(0, 4))]
        while g % 4 == 0 and len(texts) < 8:
            texts.append(replaced(rng, texts[-1], 6))
        rng.shuffle(texts)
        for t in texts:
            rows.append((n, " ".join(t)))
            n += 1
    got = kept(neardup.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)))
    want = plain_kept(rows)
    assert 60 <= len(want) < len(rows) - 60
    assert got == want


def test_edge_rows_and_columns(docs, rows, no_docs):
    out = neardup.keep_first(docs)
    assert out.columns == docs.columns
    assert kept(out) == plain_kept([r[:2] for r in rows])
    assert neardup.keep_first(no_docs).count() == 0


def test_stage_uses_it(spark):
    import corpus_pipeline
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 999)}" for _ in range(300)]
    rows = [(i, " ".join(replaced(rng, base, 3) if i else base)) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()] == [0]


def test_a_large_group_of_dissimilar_look_alikes(spark):
    """2,000 versions of one text, most pairs between 0.4 and 0.8, with a few links among them, against all pairs."""
    import numpy as np
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(120)]
    texts = []
    for _ in range(1960):
        texts.append(replaced(rng, base, rng.choice([1, 2, 3, 5, 6, 7, 8, 9, 10, 12])))
    for _ in range(40):  # links between nodes far from the base
        texts.append(replaced(rng, rng.choice(texts), rng.choice([1, 2, 3])))
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [neardup.shingles(t) for _, t in rows]
    every, at = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.zeros((len(sets), len(every)), dtype=np.float32)
    held[np.repeat(np.arange(len(sets)), list(map(len, sets))), at] = 1
    both, n = held @ held.T, held.sum(axis=1)
    root = np.arange(len(rows))
    link = 5 * both >= 4 * (n[:, None] + n[None] - both)
    while True:
        least = np.where(link, root[None], len(rows)).min(axis=1)
        if (least == root).all():
            break
        root = least
    want = sorted(set(root.tolist()))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted(r.doc_id for r in neardup.keep_first(df).select("doc_id").collect())
    assert 500 < len(want) < 1900 and got == want


def test_reference_and_spread_change_nothing(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(60)]
    rows = [(i, " ".join(replaced(rng, base, rng.randint(0, 6)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = plain_kept(rows)
    for reference, spread in ((1, 7), (0, 40)):
        monkeypatch.setattr(neardup, "REFERENCE", reference)
        monkeypatch.setattr(neardup, "SPREAD", spread)
        assert kept(neardup.keep_first(df)) == want


def edited(rng):
    """60 texts of 400 words, each with three copies that have 1 to 8 words replaced."""
    pool = [f"w{i}" for i in range(5000)]
    texts = []
    for _ in range(60):
        base = rng.choices(pool, k=400)
        texts += [base] + [replaced(rng, base, rng.randint(1, 8)) for _ in range(3)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_anchors_give_the_candidates(spark):
    """Every pair of fingerprints within 2 bits, and most within 6, are candidates; all are within the documented bits."""
    rows = edited(random.Random(13))
    one = neardup.nodes_of(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    fp = {r.node: r.fp & (1 << 64) - 1 for r in one.collect()}
    sets = [neardup.shingles(t) for _, t in rows]
    assert sorted(fp.values()) == sorted(simhash.majority(s) for s in sets)
    got = {frozenset((r.a, r.b)) for r in neardup.anchor_pairs(one).collect()}
    bits = {frozenset((a, b)): (fp[a] ^ fp[b]).bit_count() for a in fp for b in fp if a < b}
    close = {p for p, d in bits.items() if d <= simhash.LINK_BITS}
    assert len(close) >= 10 and close <= got
    assert len(got - close) >= 30 and all(bits[p] <= neardup.NEAR_BITS for p in got)


def test_anchors_link_before_the_keys(spark):
    """Without any key, anchors alone join copies, and never below 0.8; with keys the result is that of brute force."""
    rows = edited(random.Random(14))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    one = neardup.nodes_of(df)
    _, root = neardup.links(one.withColumn("keys", F.array().cast("array<bigint>")), df)
    stays = {r.node: r.stays.doc_id for r in one.collect()}
    joined = [(stays[r.node], stays[r.root]) for r in root.collect()]
    assert len({a for a, b in joined if a != b}) >= 60
    assert all(a // 4 == b // 4 for a, b in joined)
    assert kept(neardup.keep_first(df)) == plain_kept(rows)


def test_one_fingerprint_many_texts(spark):
    """Long texts that differ in one word share a fingerprint; each is compared and joined."""
    rng = random.Random(15)
    base = [f"w{rng.randint(0, 10 ** 6)}" for _ in range(20000)]
    rows = [(i, " ".join(replaced(rng, base, 1 if i else 0))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    one = neardup.nodes_of(df)
    assert one.count() == 12 and one.select("fp").distinct().count() < 12
    assert neardup.anchor_pairs(one).select(F.explode(F.array("a", "b"))).distinct().count() == 12
    assert kept(neardup.keep_first(df)) == plain_kept(rows)


def test_fingerprints_two_bits_apart_share_an_anchor_at_half_the_reach():
    rng = random.Random(16)
    rows = 0
    for _ in range(400):
        a = b = rng.getrandbits(64)
        for k in rng.sample(range(64), rng.randint(0, 2)):
            b ^= 1 << k
        near = set(simhash.anchors(a, reach=1))
        rows += len(near)
        assert near & set(simhash.anchors(b, reach=1))
    assert rows < 400 * 16
