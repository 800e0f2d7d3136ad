"""Near-duplicates of whole documents: links at a Jaccard similarity of at least 0.8 between sets of five-word shingles.

Documents with one set of shingles collapse to a node. Candidates come in two ways:

* A node has a SimHash fingerprint, the majority bits of its shingles, which goes through the anchors of ``simhash``.
  Every pair of fingerprints at ``LINK_BITS`` or fewer differing bits is a candidate, which is at most 2,080 pairs a
  fingerprint. Fingerprints further apart often meet at an anchor too: each is a candidate with the nearest of the
  centres (smallest fingerprints at an anchor) that it meets within ``NEAR_BITS``.
* At a similarity of 0.8 fingerprints differ in about 10 of 64 bits, beyond any radius that anchors can cover. So a node
  has ``BANDS`` keys for the rest, each a hash of ``ROWS`` MinHash values; nodes that share a key are candidates. Two sets
  at similarity s share a key with probability 1 - (1 - s^6)^48, so a pair at 0.8 is missed once in two million, one at
  0.9 never in practice; this is the only approximation.

Each candidate link is checked on the full sets: nothing below 0.8 links. The links that anchors show come first; nodes
that they join aren't compared again.

Nodes that share a key with the same smallest node (its centre) form a group, so two nodes that share a key share a group.
Components of the rest come in three steps, none of which enumerates a group's pairs:

1. Each node is compared with its centres, unless the anchors joined them.
2. Groups that still hold several components get a reference set: what over half of a small sample of their nodes hold.
   Any reference gives right results, a close one gives short differences. Every node is replaced by its difference from
   the reference c: r shingles removed, a added. As |x & y| = |c| - r1 - r2 + (shared elements of the differences), a
   pair links if and only if the shared elements number at least T = ceil((w1 + w2) / 18) with w = 8 n + 18 r - 9 |c|.
   So where w1 + w2 <= 0 any two nodes link. All nodes for which that holds with the group's node of least w join it.
3. For the rest T is positive, and a link must show among the rarest elements of both differences (elements are ordered by
   their number of nodes in the group; the first d - T + 1 of d are enough). Nodes meet at such elements if their
   sizes and positions allow T shared ones, and then the differences are compared.

Everything is exact, given the keys: no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import per_row, written
from .simhash import LINK_BITS, _signed, components, kept_rows, majority, placed

WORDS, SEED = 5, 42
#: Least similarity of a link, as a fraction of whole numbers.
SIMILAR = (4, 5)
#: Most differing bits of fingerprints that are compared because they met at an anchor.
NEAR_BITS = 12
BANDS, ROWS = 48, 6
_RNG = np.random.Generator(np.random.PCG64(SEED))
TIMES = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)
CHUNK = 512
#: Nodes of a group whose sets make its reference, and members of a group that share a copy of it. Neither changes results.
REFERENCE, SPREAD = 32, 256


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles of the text with A-Z in lower case; empty without words.

    A text of fewer words is one shingle.
    """
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    parts = map(b" ".join, zip(*[w[i:] for i in range(WORDS)])) if len(w) >= WORDS else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, SEED) for s in parts], dtype=np.uint64))


def band_keys(h: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles; none for the empty set."""
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), CHUNK):
            np.minimum(least, (h[None, at:at + CHUNK] * TIMES + PLUS).min(axis=1), out=least)
        key = np.arange(BANDS, dtype=np.uint64)
        for column in least.reshape(BANDS, ROWS).T:
            key = (key ^ column) * np.uint64(0xFF51AFD7ED558CCD)
            key ^= key >> np.uint64(33)
    return key.view(np.int64)


def with_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, h a hash of the text, node a hash of its set, n the set's size, fp its SimHash, keys)."""
    def make():
        def fn(ids, texts, h):
            sets = [shingles(t) for t in texts]
            node = [xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets]
            return (ids, h, np.array(node, dtype=np.uint64).view(np.int64), list(map(len, sets)),
                    [_signed(majority(s)) for s in sets], [band_keys(s) for s in sets])
        return fn
    return per_row(docs.select("doc_id", "text", F.xxhash64("text").alias("h")),
                   "doc_id bigint, h bigint, node bigint, n bigint, fp bigint, keys array<bigint>", make)


def nodes_of(docs: DataFrame) -> DataFrame:
    """(node, n, fp, keys, stays) of the distinct sets, ``stays`` the row that represents a set."""
    rows = written(with_keys(docs), "shingled")
    row = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "h")
    return written(rows.groupBy("node").agg(F.min(row).alias("stays"), *[F.first(c).alias(c) for c in ("n", "fp", "keys")]),
                   "nodes")


def anchor_pairs(one: DataFrame) -> DataFrame:
    """Nodes (node, n, fp) to candidate pairs (a, b) by the anchors of their fingerprints.

    Nodes with one fingerprint are compared with the smallest of them, which stands for the fingerprint.
    """
    heads = written(one.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("head")), "heads")
    # Two fingerprints 2 bits apart have one between them, whose own anchor is within one more than the radius of both.
    at = written(placed(heads.select("fp"), own=False, reach=LINK_BITS // 2), "anchors")
    a = at.select("anchor", F.col("fp").alias("a"), F.min("fp").over(Window.partitionBy("anchor")).alias("centre"))
    bits = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    limit = F.when(F.col("a") == F.col("centre"), NEAR_BITS).otherwise(LINK_BITS)
    met = written(a.join(at.withColumnRenamed("fp", "b"), "anchor").where((F.col("a") < F.col("b")) & (bits <= limit))
                  .select("a", "b", bits.alias("bits")).distinct(), "met")
    near = met.groupBy("b").agg(F.min(F.struct("bits", "a")).alias("near")).select("near.a", "b")
    pairs = met.where(F.col("bits") <= LINK_BITS).select("a", "b").unionByName(near).distinct()
    ha, hb = [heads.select(F.col("fp").alias(k), F.col("head").alias(f"h{k}")) for k in "ab"]
    between = pairs.join(ha, "a").join(hb, "b").select("ha", "hb")
    within = one.join(heads, "fp").where("node <> head.node").select(
        F.col("head").alias("ha"), F.struct("node", "n").alias("hb"))
    return between.unionByName(within).where(near_sizes("ha.n", "hb.n")).select(
        F.col("ha.node").alias("a"), F.col("hb.node").alias("b"))


def near_sizes(x: str, y: str) -> Column:
    """Whether sets of these sizes can reach ``SIMILAR``."""
    top, of = SIMILAR
    return (of * F.col(x) >= top * F.col(y)) & (of * F.col(y) >= top * F.col(x))


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets (node, shingles) of nodes (node, stays), each from the text of the row that ``stays`` names."""
    nodes = nodes.select("node", F.col("stays.doc_id").alias("of_id"), F.col("stays.h").alias("of_h"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    rows = rows.join(nodes, rows.doc_id.eqNullSafe(nodes.of_id) & (rows.h == nodes.of_h)).select("node", "text")

    def make():
        return lambda nodes, texts: (nodes, [shingles(t).view(np.int64) for t in texts])
    # Rows that repeat doc_id and text repeat their set.
    return per_row(rows.dropDuplicates(["node"]), "node bigint, shingles array<bigint>", make, rows=64)


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach ``SIMILAR``."""
    top, of = SIMILAR
    a, b = [sets.select(F.col("node").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab"]
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(b, "b").join(a, "a")
            .where(of * both >= top * (F.size("sa") + F.size("sb") - both)).select("a", "b"))


def references(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Members (least, node) of groups to (least, c): what over half of a sample of the group's nodes hold."""
    nth = F.row_number().over(Window.partitionBy("least").orderBy(F.xxhash64("least", "node")))
    sample = members.select("least", "node", nth.alias("nth")).where(F.col("nth") <= REFERENCE).drop("nth")
    held = (sample.join(sets, "node").select("least", F.explode("shingles").alias("s"))
            .groupBy("least", "s").count())
    size = sample.groupBy("least").agg(F.count(F.lit(1)).alias("size"))
    return (held.join(size, "least").where(2 * F.col("count") > F.col("size"))
            .groupBy("least").agg(F.collect_list("s").alias("c")))


def differences(members: DataFrame, sets: DataFrame, reference: DataFrame) -> DataFrame:
    """(least, node, root, w, r, a, diff) of members (least, node, root), diff the elements that only one side holds."""
    # A centre's reference is repeated for every SPREAD members, so that no task holds a large group.
    count = members.groupBy("least").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("salts"))
    salted = members.join(count, "least").withColumn("salt", F.pmod(F.xxhash64("node"), "salts").cast("int"))
    reference = (count.join(reference, "least", "left")
                 .select("least", F.coalesce("c", F.array().cast("array<bigint>")).alias("c"),
                         F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")))
    rows = salted.join(sets, "node").join(reference, ["least", "salt"]).select("least", "node", "root", "shingles", "c")

    def make():
        def fn(least, node, root, own, c):
            out = [[] for _ in range(4)]
            for x, ref in zip(own, c):
                x, ref = np.array(x, dtype=np.int64), np.array(ref, dtype=np.int64)
                r, a = np.setdiff1d(ref, x, assume_unique=True), np.setdiff1d(x, ref, assume_unique=True)
                for col, v in zip(out, (8 * len(x) + 18 * len(r) - 9 * len(ref), len(r), len(a), np.concatenate([r, a]))):
                    col.append(v)
            return least, node, root, *out
        return fn
    return per_row(rows, "least bigint, node bigint, root bigint, w bigint, r bigint, a bigint, diff array<bigint>", make, rows=64)


def close_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Differences of groups to links (a, b): those that the sizes alone prove, and those that the elements show."""
    best = rows.groupBy("least").agg(F.min(F.struct("w", "node")).alias("best"))
    rows = rows.join(best, "least").withColumn(
        "sure", (F.col("w") + F.col("best.w") <= 0) | (F.col("node") == F.col("best.node")))
    rows = written(rows, "placed")
    proven = rows.where("sure AND node <> best.node").select(F.col("best.node").alias("a"), F.col("node").alias("b"))
    rest = rows.where("NOT sure").groupBy("least").agg(F.min("w").alias("rest_w"))
    rows = rows.join(rest, "least")  # groups that the sizes settle are done
    need = F.ceil((F.col("w") + F.when(F.col("sure"), F.col("rest_w")).otherwise(F.col("best.w"))) / 18)
    rows = rows.withColumn("need", F.greatest(need, F.lit(1)).cast("int")).where(F.size("diff") >= F.col("need"))
    elements = rows.select("least", "node", F.explode("diff").alias("s"))
    shared = elements.groupBy("least", "s").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    ordered = elements.join(shared, ["least", "s"]).groupBy("least", "node").agg(
        F.array_sort(F.collect_list(F.struct("times", "s"))).alias("shared"))
    # Elements of one node only come first and meet nobody; they just use up the front.
    ordered = rows.select("least", "node", "root", "w", "r", "a", "sure", "need", F.size("diff").alias("d")).join(
        ordered, ["least", "node"])
    alone = F.col("d") - F.size("shared")
    front = F.greatest(F.col("d") - F.col("need") + 1 - alone, F.lit(0))
    post = written(ordered.withColumn("alone", alone).select(
        "least", "node", "root", "w", "r", "a", "sure", "d", "alone",
        F.posexplode(F.slice("shared", 1, front)).alias("at", "e")).select(
        "least", F.col("e.s").alias("s"), "node", "root", "w", "r", "a", "sure",
        (F.col("d") - F.col("alone") - F.col("at")).alias("left")), "postings")
    x, y = [post.select("least", "s", *[F.col(c).alias(f"{c}{k}") for c in ("node", "root", "w", "r", "a", "left", "sure")])
            for k in "xy"]
    t = F.ceil((F.col("wx") + F.col("wy")) / 18)
    fits = ((t <= F.least("leftx", "lefty")) & (t <= F.least("rx", "ry") + F.least("ax", "ay")) & (F.col("rootx") != F.col("rooty"))
            & (F.col("surey") | (F.col("nodex") < F.col("nodey"))))
    met = (x.where("NOT surex").join(y, (x.least == y.least) & (x.s == y.s) & fits)
           .select(x.least, "nodex", "nodey", t.alias("t")).distinct())
    dx, dy = [rows.select("least", F.col("node").alias(f"node{k}"), F.col("diff").alias(f"diff{k}")) for k in "xy"]
    shown = (met.join(dx, ["least", "nodex"]).join(dy, ["least", "nodey"])
             .where(F.size(F.array_intersect("diffx", "diffy")) >= F.col("t"))
             .select(F.col("nodex").alias("a"), F.col("nodey").alias("b")))
    return proven, shown


def links(one: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, n, fp, keys, stays) to links (a, b), and (node, root) of the nodes that links reach.

    The links leave out those inside a component that others already hold together.
    """
    anchored = written(anchor_pairs(one), "anchored")
    bands = one.select("node", "n", F.explode("keys").alias("key"))
    shared = written(bands.groupBy("key").agg(F.min(F.struct("node", "n")).alias("first"), F.max("node").alias("last"))
                     .where("first.node < last")
                     .select("key", F.col("first.node").alias("least"), F.col("first.n").alias("least_n")), "shared-keys")
    members = written(bands.join(shared, "key").select("least", "least_n", "node", "n").distinct(), "members")
    met = members.select("node").unionByName(anchored.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    sets = written(sets_of(docs, one.join(met, "node", "left_semi")), "sets")
    close = written(similar(anchored, sets), "links")
    joined = components(close)
    own, centres = [joined.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root")) for k in ("node", "least")]
    stars = (members.where((F.col("node") > F.col("least")) & near_sizes("n", "least_n"))
             .join(own, "node", "left").join(centres, "least", "left")
             .where(F.coalesce("node_root", "node") != F.coalesce("least_root", "least"))
             .select(F.col("least").alias("a"), F.col("node").alias("b")))
    first = written(close.unionByName(similar(stars, sets)), "links")
    root = components(first)
    rooted = written(members.join(root, "node", "left").select("least", "node", F.coalesce("root", "node").alias("root")),
                     "members")
    # A group of two is a centre and a node compared with it.
    open_ = rooted.groupBy("least").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"))
    open_ = written(rooted.join(open_.where("low < high AND size > 2").select("least"), "least", "left_semi"), "open")
    rows = written(differences(open_, sets, references(open_, sets)), "differences")
    proven, shown = close_pairs(rows)
    more = written(proven.unionByName(shown).distinct(), "links")
    every = first.unionByName(more)
    return every, root if more.isEmpty() else components(every)


def keep_first(docs: DataFrame) -> DataFrame:
    """Documents with one row of each component of near-duplicates, kept whole: the smallest doc_id, null last.

    Texts without words are copies of one another. Of rows that repeat the kept doc_id and text one stays. All columns
    and their order stay; an empty table gives no rows.
    """
    one = nodes_of(docs)
    _, root = links(one, docs)
    names = one.select("node", "stays").join(root, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
    return kept_rows(docs, names.agg(F.min("stays").alias("stays")))
