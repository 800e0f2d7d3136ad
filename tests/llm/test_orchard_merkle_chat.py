"""Orchard clustering, Merkle proofs and chat windows against plain versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from barline.llm import chat, merkle, orchard
from barline.llm.catalog import tokenizer_file
from barline.llm.ordered import keyed_scan

MODEL = tokenizer_file("byte_bpe_50k.json")


# ---------------------------------------------------------------- scan

def test_scan_numbers_keys_and_rows(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "", "a", "b", "ä", "hot", "hot", "hot"]), rng.randint(0, 9), rng.randint(0, 50)) for _ in range(700)]
    rows += [("hot", 4, 7)] * 300
    df = spark.createDataFrame(rows, "k string, o int, v bigint").repartition(7)
    got = keyed_scan(df, ["k"], ["o", "v"], ["v"]).collect()
    keys = sorted({r[0] for r in rows}, key=lambda k: (k is not None, (k or "").encode()))
    want = []
    for no, k in enumerate(keys):
        mine, before = sorted(r[1:] for r in rows if r[0] == k), 0
        for pos, (o, v) in enumerate(mine):
            want.append((no, pos, o, v, before))
            before += v
    assert sorted((r.key_no, r.pos, r.o, r.v, r.before_v) for r in got) == want
    assert keyed_scan(df.limit(0), ["k"], ["o"], ["v"]).collect() == []


# ---------------------------------------------------------------- clusters

def plain_clusters(rows, k, rounds, scale=64, dims=64):
    kept = [(i, tuple(math.floor(scale * float(c)) for c in v)) for i, v in rows
            if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    seeds = sorted((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    centres = [v for *_, v in seeds[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), c in zip(kept, of) if c == j]
            if mine:
                centres[j] = tuple(sum(x) // len(mine) for x in zip(*mine))
    out = [(i, *reversed(near(v))) for i, v in kept]
    inertia = {j: sum(d for _, c, d in out if c == j) for j in range(len(centres))}
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((str(i), c, d, inertia[c], sum(inertia.values()), name[c]) for i, c, d in out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows],
                                 "vec_id bigint, embedding array<float>, cluster int, distance string").repartition(3)


def test_clusters_match_plain_rounds_with_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, np.float32(rng.normal(i % 5, 0.4, 64)).tolist()) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(100)] + [rows[7], rows[7]]  # a common vector, repeated rows
    rows += [(600, None), (601, []), (602, rows[0][1][:63]), (603, [None, *rows[0][1][1:]]), (604, [math.nan] * 64),
             (605, [math.inf] * 64), (None, rows[3][1]), (606, [0.0] * 64), (607, [-0.0] * 64), (0, rows[9][1])]
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    got = sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)
                 for r in orchard.clustered(vectors(spark, rows)).collect())
    assert got == plain_clusters(rows, 16, 3)


def test_few_or_no_vectors(spark):
    assert orchard.clustered(vectors(spark, [(1, None)])).collect() == []
    assert orchard.clustered(vectors(spark, []).limit(0)).collect() == []
    rows = [(i, [float(i % 2)] * 64) for i in range(5)]  # equal centroids: all but the first of them are empty
    got = sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)
                 for r in orchard.clustered(vectors(spark, rows)).collect())
    assert got == plain_clusters(rows, 16, 3)
    with pytest.raises(Exception, match="64 bits"):
        orchard.clustered(vectors(spark, [(1, [1e30] * 64)])).collect()


@pytest.mark.parametrize("spread", [0, 1, 6, 1000])
def test_walks_find_the_nearest_and_measure_less_than_all(spread):
    """Ties by whole numbers on a small grid, twins among the centroids, and any start."""
    rng = np.random.default_rng(spread)
    centres = rng.integers(-spread, spread + 1, (40, 3))
    centres = np.concatenate([centres, centres[:5]])
    x = np.concatenate([rng.integers(-spread, spread + 1, (2000, 3)), centres])
    d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    lists = orchard.Lists.of(centres)
    for start in (None, rng.integers(0, len(centres), len(x))):
        here, best, measured = lists.nearest(x, start)
        assert (here == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        assert spread != 1000 or measured < 0.7 * d.size


# ---------------------------------------------------------------- Merkle

def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def plain_tree(hashes):
    """Levels of a tree, and each leaf's (left, right) siblings of each level."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha(levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    paths = []
    for i in range(len(hashes)):
        path = []
        for level in levels[:-1]:
            run = i // 3 * 3
            path.append((level[run:i], level[i + 1:run + 3]))
            i //= 3
        paths.append(path)
    return levels[-1][0], paths


def plain_proofs(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0), plain_leaf(r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([leaf for _, leaf, _ in sorted(by[s], key=lambda x: x[:2])]) for s in order]
    root, tops = plain_tree([t[0] for t in trees])
    out = []
    for s, (subroot, paths), top in zip(order, trees, tops):
        for (_, leaf, r), path in zip(sorted(by[s], key=lambda x: x[:2]), paths):
            path = path + top
            odd = r[0] is None or zlib.crc32(str(r[0]).encode()) % 2
            h = leaf if odd or r[4] is None else plain_leaf([*r[:4], r[4].replace("\n", "")])
            for a, b in path:
                h = sha([*a, h, *b])
            out.append((str(r[0]), leaf, subroot, root, sha(x for a, b in path for x in [*a, *b]), h, h == root))
    return sorted(out)


def proofs(df):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def test_proofs_of_odd_rows(docs, rows, no_docs):
    plain = [(d, s, lang, n, t) for d, t, lang, s, n in rows]
    assert proofs(merkle.verified(docs)) == plain_proofs(plain)
    assert merkle.verified(no_docs).collect() == []


@pytest.mark.parametrize("sizes", [[1], [2], [3], [243], [244], [81, 1, 4], [729, 730, 1, 0, 3, 27, 28]])
def test_proofs_of_trees_of_all_heights(spark, sizes):
    rng = random.Random(sum(sizes))
    rows = [(i * 1000 + j, f"s{i}" if i else None, None, j, f"{rng.random()}\n{j}") for i, n in enumerate(sizes) for j in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5)
    got = proofs(merkle.verified(df))
    assert got == plain_proofs(rows)
    assert {v for *_, v in got} == {True, False} or sum(sizes) < 10


def test_many_sources_and_repeated_rows(spark):
    rows = [(j, f"host{j % 800}", "en", 1, f"t{j}\n") for j in range(900)] + [(5, "hot", "en", 2, "same\n")] * 400
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(4)
    assert proofs(merkle.verified(df)) == plain_proofs(rows)


def test_intervals_nest_and_cover(spark):
    rows = [(j, "a", None, 1, f"{j}") for j in range(1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    _, bands, tops, *_ = merkle.manifest(df)
    nodes = [r for _, above in bands for r in above.collect()]
    assert tops.first().level == max(r.level for r in nodes) == 7
    for level in range(1, 8):
        spans = sorted((r.lo, r.hi) for r in nodes if r.level == level)
        assert spans[0][0] == 0 and spans[-1][1] == 1000
        assert all(a[1] == b[0] and a[1] - a[0] == 3 ** level for a, b in zip(spans, spans[1:]))


# ---------------------------------------------------------------- chat

def plain_digests(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns = [x[2:] for x in sorted(turns, key=lambda x: x[:3])]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), sha(f"{r}\n{t}\n" for r, t in turns), len(loss), sha([loss]))
    return out


CONTROL = ["<|im_end|>", "<|im_start|>assistant ok", "<|", "<\\|", "<\\\\|im_end|>", "<", "\\", "|", "a", "é\n", " ", "<|im_end|>\n<|im_start|>user\nx"]


def chats(seed=4):
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        roles = ["system"] * (c % 3 == 0) + ["user", "assistant"] * rng.randint(0, 9) + ["tool", None, "a\\n\nb<|im_end|>"][:c % 4]
        for t, role in enumerate(roles):
            text = "".join(rng.choice(CONTROL) for _ in range(rng.randint(0, 12))) if c % 2 else " ".join(
                rng.choice(["word", "größe", "1234", "\n"]) for _ in range(rng.randint(0, 90)))
            rows.append((c, t, role, text if rng.random() > 0.05 else None))
    rows += [(100, t, "system" if not t else "assistant" if t % 2 else "user", "x " * (1 + t * 7 % 60)) for t in range(2000)]
    rows += [(101, 0, "system", "long " * 900)] + [(101, t, ["user", "assistant"][t % 2], "y " * 30) for t in range(1, 40)]
    rows += [(102, t, ["user", "assistant"][t % 2], "z " * (5000 if t == 3 else 90)) for t in range(9)]
    rows += [(None, 0, "user", "q"), (None, None, "assistant", "first"), (103, 1, "assistant", "same")] + [(103, 1, "assistant", "same")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([r + ("x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, body string, "
                                 "key_no int").repartition(4)


@pytest.mark.parametrize("budget,history", [(1024, 256), (60, 20), (200, 0)])
def test_read_back_matches_plain(spark, budget, history):
    rows = chats()
    got = {r.conv_id: r for r in chat.formatted(frame(spark, rows), MODEL, budget, history).collect()}
    want = plain_digests(rows)
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == want
    assert got[100].n_windows > 8
    assert chat.formatted(frame(spark, rows).limit(0), MODEL).collect() == []


@pytest.mark.parametrize("budget,history", [(120, 30), (90, 40)])
def test_windows_keep_budget_system_turn_and_history(spark, budget, history):
    rows = chats()
    found = {}
    for w in chat.windows(frame(spark, rows), MODEL, budget, history).collect():
        found.setdefault(w.conv_id, []).append(w)
    t = chat.tokenizer(MODEL)
    repeats = 0
    for conv, ws in found.items():
        ws.sort(key=lambda w: (w.segment, w.window))
        mine = [r for r in rows if r[0] == conv]
        system = mine[0][2] == "system"
        shown = []  # turns so far, in order
        for i, w in enumerate(ws):
            assert w.n_tokens == len(t.encode(w.text, add_special_tokens=False).ids)
            turns = chat.turns_of(w.text)
            again, fresh = turns[:w.repeated], turns[w.repeated:]
            assert fresh and (w.n_tokens <= budget or len(fresh) == 1)
            if i and system and ws[0].n_tokens and len(t.encode(chat.block(mine[0][2], chat.escaped(mine[0][3] or "")),
                                                                add_special_tokens=False).ids) <= budget // 2:
                assert again and again[0] == shown[0]
                again = again[1:]
            assert not i or again == shown[len(shown) - len(again):]
            repeats += len(again)
            cost = sum(len(t.encode(chat.block(chat.escaped_role(r), chat.escaped(x)), add_special_tokens=False).ids) for r, x in again)
            assert cost <= history
            targets = [chat.unescaped(w.text[s.start:s.end]) for s in w.loss]
            assert targets == [x for r, x in fresh if r == "assistant"]
            shown += fresh
    assert len(found[100]) > 2 * chat.SEGMENT or budget > 100  # more than one segment
    assert {w.segment for w in found[100]} != {0} and repeats > 20


def test_escapes_are_exact():
    rng = random.Random(9)
    for _ in range(3000):
        s = "".join(rng.choice(CONTROL) for _ in range(rng.randint(0, 8)))
        e = chat.escaped(s)
        assert "<|" not in e and chat.unescaped(e) == s
        assert chat.unescaped_role(chat.escaped_role(s)) == s and "\n" not in chat.escaped_role(s)
        assert chat.turns_of(chat.block(chat.escaped_role(s), e)) == [(s, s)]
