"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into two 23-bit blocks and 18 free bits. The anchors are all pairs of words of the perfect
binary Golay code: every block lies within distance 3 of exactly one of its 4,096 words, so the product code of 2**24
anchors covers the 46 bits with radius 3 + 3. If two fingerprints differ in at most 2 bits, the second lies within the
covering radius plus 2 of the first one's own anchor, with excesses over the radius that add up to at most 2. So each
distinct fingerprint is homed at its own anchor and replicated to every anchor within that reach (61 on average,
whatever the data), and homes meet replicas of the same anchor only. The comparison is an equi-join on the anchor with
an exact check of the distance on all 64 bits: every link between different fingerprints is found.

Copies collapse before the replication: the join sees each fingerprint once, so a group of copies of any size costs one
row. Components are found by large-star / small-star rounds on fingerprints, with the edges written to the shared
folder between rounds.
"""

from __future__ import annotations

import functools

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import per_row, wrapped, written

SEED, WORDS, LINK_BITS = 42, 3, 2
BLOCK_BITS, RADIUS = 23, 3
#: Generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have set; 0 without hashes."""
    h = h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at:at + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of word shingles of the text with A-Z in lower case; 0 without words."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*[w[i:] for i in range(words)])) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(s, seed) for s in shingles], dtype="<u8"))


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def with_fingerprint(df: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, text) to (doc_id, h a hash of the text, fp BIGINT, the 64 bits as a signed number)."""
    def make():
        return lambda ids, texts, h: (ids, h, [_signed(fingerprint(t, words, seed)) for t in texts])
    return per_row(df.select("doc_id", "text", F.xxhash64("text").alias("h")), "doc_id bigint, h bigint, fp bigint", make)


@functools.cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Per syndrome the lowest-weight error pattern, and all patterns of weight up to 5 ordered by syndrome."""
    def syndrome(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        for bit in range(BLOCK_BITS - 1, 10, -1):
            v ^= np.where(v >> bit & 1, GOLAY << (bit - 11), 0)
        return v
    patterns, last = [np.zeros(1, dtype=np.int64)], [np.array([-1])]
    for _ in range(RADIUS + LINK_BITS):
        grown = [(p | 1 << np.arange(top + 1, BLOCK_BITS), np.arange(top + 1, BLOCK_BITS))
                 for p, top in zip(patterns[-1], last[-1])]
        patterns.append(np.concatenate([g[0] for g in grown]))
        last.append(np.concatenate([g[1] for g in grown]))
    every = np.concatenate(patterns)
    weight = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    s = syndrome(every)
    order = np.lexsort((weight, s))
    every, weight, s = every[order], weight[order], s[order]
    start = np.searchsorted(s, np.arange(2049))
    return every, weight, start, syndrome


def anchors(fp: int, own: bool = False, reach: int = LINK_BITS) -> list[int]:
    """Anchors within reach of a fingerprint (excesses over the radius of ``reach`` in all), or only its own."""
    every, weight, start, syndrome = _golay()
    near = []
    for shift in (0, BLOCK_BITS):
        block = fp >> shift & (1 << BLOCK_BITS) - 1
        s = int(syndrome(np.array([block]))[0])
        part = slice(start[s], start[s + 1])
        near.append((block ^ every[part], np.maximum(weight[part] - RADIUS, 0)))
    (a, ea), (b, eb) = near
    fits = ea[:, None] + eb[None, :] <= (0 if own else reach)
    return (a[:, None] | b[None, :] << BLOCK_BITS)[fits].tolist()


def placed(fps: DataFrame, own: bool, reach: int = LINK_BITS) -> DataFrame:
    """(fp) to (anchor, fp): one row for the own anchor, or one for each anchor within reach."""
    def make():
        def fn(col):
            rows = [(x, v) for v in col for x in anchors(v & (1 << 64) - 1, own, reach)]
            return tuple(map(list, zip(*rows))) if rows else ([], [])
        return fn
    return per_row(fps.select("fp"), "anchor bigint, fp bigint", make)


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) to all pairs (a, b), a < b, at ``LINK_BITS`` or fewer differing bits."""
    homes = placed(fps, own=True).select("anchor", F.col("fp").alias("a"))
    probes = placed(fps, own=False).select("anchor", F.col("fp").alias("b"))
    # Spark takes the replicas for as few as the fingerprints, a 61st of what they are, and would broadcast them.
    return (homes.join(probes.hint("merge"), "anchor")
            .where((F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LINK_BITS) & (F.col("a") < F.col("b")))
            .select("a", "b"))


def components(edges: DataFrame, least: str = "a", other: str = "b") -> DataFrame:
    """Edges between different nodes to (node, root), root the smallest node of its component; linked nodes only.

    Alternates large-star and small-star until nothing changes. A round sends each node its smallest neighbour by a
    join, never a node's whole neighbourhood to one task; rounds grow with the logarithm of a component's diameter.
    """
    e = written(edges.select(F.least(least, other).alias("lo"), F.greatest(least, other).alias("hi")).distinct(),
                "edges")
    while True:
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
            e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        top = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(top, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
                 .where("hi <> lo").distinct())
        large = written(large, "large")
        low = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = large.join(low, large.hi == low.u)
        small = small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").unionByName(
            low.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct()
        small = written(small, "small")
        # Done when the edges form stars: each larger node has one edge and no root is itself a larger node.
        forked = small.groupBy("hi").count().where("count > 1").select("hi")
        chained = small.join(small.select(F.col("lo").alias("hi")).distinct(), "hi", "left_semi").select("hi")
        e = small
        if forked.unionByName(chained).isEmpty():
            break
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, fp) and, per fingerprint, its component: (fp, component_id, stays).

    ``stays`` names the row that represents the component by (null flag, doc_id, h), null ids last.
    """
    fps = written(with_fingerprint(docs), "fingerprints")
    row = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "h")
    one = written(fps.groupBy("fp").agg(F.min(row).alias("stays")), "distinct")
    root = components(links(one))
    known = written(one.join(root, one.fp == root.node, "left").select(
        "fp", "stays", F.coalesce("root", "fp").alias("root")), "roots")
    best = known.groupBy("root").agg(F.min("stays").alias("stays"))
    return fps, known.select("fp", "root").join(best, "root").select(
        "fp", F.col("stays.doc_id").alias("component_id"), "stays")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id that links reach, its own included).

    Null or empty texts have fingerprint 0 and link like any other. A null doc_id keeps its row; it never is the
    smallest of a component unless all are null. Repeated rows stay. An empty table gives no rows. Other columns are
    not read, whatever their names.
    """
    fps, of = classes(docs)
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def kept_rows(docs: DataFrame, of: DataFrame) -> DataFrame:
    """The documents that ``stays`` names, one row each, with their columns."""
    keep = of.select(F.col("stays.doc_id").alias("keep_id"), F.col("stays.h").alias("keep_h")).distinct()
    rows = wrapped(docs, id=F.col("doc_id"), h=F.xxhash64("text"))
    kept = rows.join(keep, rows.id.eqNullSafe(keep.keep_id) & (rows.h == keep.keep_h), "left_semi")
    w = Window.partitionBy("id", "h").orderBy(F.xxhash64("row"))
    return kept.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("row.*")


def keep_first(docs: DataFrame) -> DataFrame:
    """Documents with one row of each component, kept whole: the smallest doc_id, null last.

    Of rows that repeat that doc_id and text one stays. All columns and their order stay.
    """
    _, of = classes(docs)
    return kept_rows(docs, of)


def hex_fingerprint(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
