"""Merkle manifest of a dataset as nested intervals of leaf ranks.

Every node of a source's tree is labelled by its level and the interval [lo, hi) of leaf ranks that it covers, so a node
lies below another one when its interval lies inside, and a node's siblings are its parent's interval less its own. No
node stores a pointer. Levels are bucketed into bands of ``BAND``; inside a band, a bucket is the interval of one node
at the band's top, with at most ``3 ** BAND`` nodes at its foot, whatever the size of a source.

* Ranks come from a range sort (``ordered.keyed_scan``), not from a window per source.
* Going up, one grouped pass a band hashes each bucket from its foot to its top.
* Going down, one grouped pass a band joins the nodes of a bucket with the path of the node above it: parents are found
  by containment, siblings by interval difference, and each node at the foot gets its path to the root. A path holds, for
  each level, how many siblings stand on the left and right, and their digests.

The subroots are the leaves of one more tree of the same kind. Bands grow with the logarithm of the largest source.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .ordered import keyed_scan

RUN, BAND = 3, 5
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
NODES = "key_no bigint, level int, lo bigint, hi bigint, digest binary"
PATHS = "key_no bigint, lo bigint, path binary, subroot binary"
PROOFS = ("doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean")


def field_hash(fields: dict) -> F.Column:
    """SHA-256 of the values in order, each as byte count, colon and text; a hyphen stands for null."""
    parts = []
    for value in fields.values():
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def combined(digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def _table(rows: list[tuple], like: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(like), like.types)],
                                names=like.names)


NODE_TYPES = pa.schema([("key_no", pa.int64()), ("level", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()),
                        ("digest", pa.binary())])
PATH_TYPES = pa.schema([("key_no", pa.int64()), ("lo", pa.int64()), ("path", pa.binary()), ("subroot", pa.binary())])
PROOF_TYPES = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in (
    "leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])


def bucketed(nodes: DataFrame, band: int) -> DataFrame:
    return nodes.withColumn("bucket", F.expr(f"lo div {RUN ** (BAND * (band + 1))}L"))


def raised(foot: DataFrame, band: int) -> DataFrame:
    """Nodes at the foot of a band to all nodes above them in the band."""
    def climb(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t["lo"].to_pylist(), t["hi"].to_pylist(), t["digest"].to_pylist()))
        key, out = t["key_no"][0].as_py(), []
        whole = t["bucket"][0].as_py() == 0 and len(rows) < RUN ** BAND  # the source ends inside this bucket
        for level in range(band * BAND + 1, (band + 1) * BAND + 1):
            if whole and len(rows) == 1:
                break
            runs = [rows[i:i + RUN] for i in range(0, len(rows), RUN)]
            rows = [(r[0][0], r[-1][1], combined([d for *_, d in r])) for r in runs]
            out += [(key, level, *r) for r in rows]
        return _table(out, NODE_TYPES)
    return bucketed(foot, band).groupBy("key_no", "bucket").applyInArrow(climb, NODES)


def build(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Leaves (key_no, pos, digest) to the foot nodes and inner nodes of each band, and each tree's (key_no, level, digest).

    The first element holds for each band a pair: its foot, then what lies above the foot.
    """
    foot = leaves.select("key_no", F.lit(0).alias("level"), F.col("pos").alias("lo"), (F.col("pos") + 1).alias("hi"), "digest")
    bands, edge = [], foot.where("lo = 0")
    while True:
        above = written(raised(foot, len(bands)), "merkle-nodes")
        bands.append((foot, above))
        edge = edge.unionByName(above.where("lo = 0"))
        foot = above.where(F.col("level") == BAND * len(bands))
        if not foot.agg(F.max("lo")).first()[0]:  # every tree has at most one node left
            break
    tops = edge.groupBy("key_no").agg(F.max("level").alias("level"), F.max_by("digest", "level").alias("digest"))
    return bands, written(tops, "merkle-tops")


def _paths(t: pa.Table):
    """Rows of one bucket to (upper row, [(foot row, its path)])."""
    rows = t.to_pylist()
    upper = [r for r in rows if r["level"] is None]
    if not upper:
        return None, []  # a finished tree's root, which the band below places
    levels: dict[int, list[dict]] = {}
    for r in rows:
        if r["level"] is not None:
            levels.setdefault(r["level"], []).append(r)
    for nodes in levels.values():
        nodes.sort(key=lambda r: r["lo"])
    order = sorted(levels, reverse=True)
    # (lo, hi) intervals of the level above with their paths; the topmost node has the path from above the band.
    paths = {(r["lo"], r["hi"]): upper[0]["path"] for r in levels[order[0]]}
    for parent, level in zip(order, order[1:]):
        lows = [r["lo"] for r in levels[parent]]
        below: dict[int, list[dict]] = {}
        for r in levels[level]:
            at = bisect_right(lows, r["lo"]) - 1
            holder = levels[parent][at]
            if not holder["lo"] <= r["lo"] < r["hi"] <= holder["hi"]:
                raise ValueError("intervals don't nest")
            below.setdefault(at, []).append(r)
        found = {}
        for at, children in below.items():
            up = paths[levels[parent][at]["lo"], levels[parent][at]["hi"]]
            for r in children:
                left = [c["digest"] for c in children if c["hi"] <= r["lo"]]
                right = [c["digest"] for c in children if c["lo"] >= r["hi"]]
                found[r["lo"], r["hi"]] = bytes([len(left), len(right)]) + b"".join(left + right) + up
        paths = found
    return upper[0], [(r, paths[r["lo"], r["hi"]]) for r in levels[order[-1]]]


def steps(path: bytes):
    """(left, right) siblings of each level, from the leaf up."""
    at = 0
    while at < len(path):
        left, right = path[at], path[at + 1]
        d = [path[i:i + 32] for i in range(at + 2, at + 2 + 32 * (left + right), 32)]
        yield d[:left], d[left:]
        at += 2 + 32 * (left + right)


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    for left, right in steps(path):
        leaf = combined([*left, leaf, *right])
    return leaf


def proof_digest(path: bytes) -> str:
    return combined([d for left, right in steps(path) for d in (*left, *right)]).hex()


def descend(bands: list, tops: DataFrame, upper: DataFrame, last, schema: str) -> DataFrame:
    """Paths of all trees' leaves: ``last`` turns a bucket of the lowest band into rows of ``schema``.

    ``upper`` is the path above each tree's root: (key_no, lo, path, subroot).
    """
    none = [F.lit(None).cast(t).alias(c) for c, t in (("level", "int"), ("hi", "bigint"), ("digest", "binary"))]
    at_band = F.when(F.col("level") == 0, 0).otherwise(F.floor((F.col("level") - 1) / BAND)).cast("int")
    tops = tops.select(F.col("key_no").alias("top_no"), at_band.alias("band"))
    carried = None
    for band in reversed(range(len(bands))):
        foot, above = bands[band]
        ends = upper.join(tops.where(F.col("band") == band), F.col("key_no") == F.col("top_no")).select(upper.columns)
        arriving = ends if carried is None else ends.unionByName(carried)
        nodes = foot.unionByName(above, allowMissingColumns=True).select(
            "*", *[F.lit(None).cast("binary").alias(c) for c in ("path", "subroot")])
        rows = bucketed(nodes.unionByName(arriving.select("*", *none), allowMissingColumns=True), band)

        def foot_paths(t: pa.Table) -> pa.Table:
            up, found = _paths(t)
            return _table([(r["key_no"], r["lo"], p, up["subroot"]) for r, p in found], PATH_TYPES)
        groups = rows.groupBy("key_no", "bucket")
        if band:
            carried = written(groups.applyInArrow(foot_paths, PATHS), "merkle-paths")
    return groups.applyInArrow(last, schema)


def manifest(docs: DataFrame) -> tuple:
    """Leaves (doc_id, source, digest, other, key_no, pos), trees of the sources, and the tree of their subroots.

    ``other`` is the digest of the tampered text, the leaf's own where nothing is tampered.
    """
    d = docs.select(*[F.col(c) for c in FIELDS])
    cols = {c: F.col(c) for c in FIELDS}
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False)) & F.contains(
        F.coalesce(F.col("text"), F.lit("")), F.lit("\n"))
    cut = field_hash(cols | {"text": F.replace("text", F.lit("\n"), F.lit(""))})
    hashed = d.select(F.col("doc_id").cast("bigint"), "source", field_hash(cols).alias("digest"),
                      F.when(tampered, cut).alias("other"))
    leaves = keyed_scan(hashed, ["source"], ["doc_id", "digest"], tag="merkle-leaves")
    bands, tops = build(leaves)
    subroots = tops.select(F.lit(0).cast("bigint").alias("key_no"), F.col("key_no").alias("pos"), "digest")
    return leaves, bands, tops, *build(subroots)


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified per document.

    Nulls are hashed as ``-``; documents of the null source form the first tree, null doc_ids come first in theirs and
    are never tampered with. Rows that share a doc_id are ordered by their leaf; equal rows are leaves of their own, side
    by side. Texts of any length are hashed whole, empty ones as ``0:``. An empty table gives no rows. Only the named
    columns are read.
    """
    spark = docs.sparkSession
    leaves, bands, tops, root_bands, root_tops = manifest(docs)
    root = next((bytes(r.digest) for r in root_tops.select("digest").collect()), b"")  # one row
    none = spark.createDataFrame([(0, 0, b"", b"")], PATHS)

    def subroot_paths(t: pa.Table) -> pa.Table:
        _, found = _paths(t)
        return _table([(r["lo"], 0, p, r["digest"]) for r, p in found], PATH_TYPES)
    upper = written(descend(root_bands, root_tops, none, subroot_paths, PATHS), "merkle-subroots")

    def proofs(t: pa.Table) -> pa.Table:
        up, found = _paths(t)
        out = []
        for r, path in found:
            other = folded(r["other"] or r["digest"], path)
            out.append((r["doc_id"], r["digest"].hex(), up["subroot"].hex(), root.hex(), proof_digest(path), other.hex(),
                        other == root))
        return _table(out, PROOF_TYPES)
    # The leaves themselves, with ids and tampered digests, are the foot of the lowest band.
    foot = leaves.select("key_no", F.lit(0).alias("level"), F.col("pos").alias("lo"), (F.col("pos") + 1).alias("hi"), "digest",
                         "other", "doc_id")
    return descend([(foot, bands[0][1]), *bands[1:]], tops, upper, proofs, PROOFS)


#: DuckDB twin of ``verified``. ``odd`` is the CRC-32 of the decimal doc_id, by its polynomial, a bit at a time.
SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS i, *, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
    string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc FROM documents),
f AS (SELECT i, doc_id, source, concat({fields}) AS head, text,
    CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM d),
l AS (SELECT i, doc_id, source, sha256(head || {text}) AS leaf, sha256(head || {other}) AS other_leaf FROM f),
k AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, i) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n FROM l),
t AS (SELECT s, 0 AS level, CAST(pos AS BIGINT) AS idx, leaf AS h, CAST(n AS BIGINT) AS n FROM k
  UNION ALL SELECT s, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM t WHERE n > 1
    GROUP BY s, level, idx // 3, n),
sub AS (SELECT s, h, level FROM t WHERE n = 1),
u AS (SELECT 0 AS level, CAST(s AS BIGINT) AS idx, h, (SELECT count(*) FROM sub) AS n FROM sub
  UNION ALL SELECT level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM u WHERE n > 1
    GROUP BY level, idx // 3, n),
root AS (SELECT h FROM u WHERE n = 1),
path AS (SELECT k.i, a.level, x.idx, x.h, x.idx < a.idx AS lft FROM k
    JOIN t a ON a.s = k.s AND a.n > 1 AND a.idx = k.pos // CAST(pow(3, a.level) AS BIGINT)
    JOIN t x ON x.s = a.s AND x.level = a.level AND x.idx // 3 = a.idx // 3 AND x.idx <> a.idx
  UNION ALL SELECT k.i, 1000 + a.level, x.idx, x.h, x.idx < a.idx FROM k
    JOIN u a ON a.n > 1 AND a.idx = k.s // CAST(pow(3, a.level) AS BIGINT)
    JOIN u x ON x.level = a.level AND x.idx // 3 = a.idx // 3 AND x.idx <> a.idx),
proof AS (SELECT i, sha256(string_agg(h, '' ORDER BY level, idx)) AS p FROM path GROUP BY i),
side AS (SELECT k.i, v.level, coalesce(string_agg(p.h, '' ORDER BY p.idx) FILTER (p.lft), '') AS a,
    coalesce(string_agg(p.h, '' ORDER BY p.idx) FILTER (NOT p.lft), '') AS b
  FROM k JOIN (SELECT s, level AS level FROM t WHERE n > 1 GROUP BY ALL
    UNION ALL SELECT sub.s, 1000 + w.level FROM sub, (SELECT DISTINCT level FROM u WHERE n > 1) w) v ON v.s = k.s
  LEFT JOIN path p ON p.i = k.i AND p.level = v.level GROUP BY k.i, v.level),
ord AS (SELECT i, row_number() OVER (PARTITION BY i ORDER BY level) AS q, a, b FROM side),
fold AS (SELECT i, CAST(0 AS BIGINT) AS q, other_leaf AS h FROM k
  UNION ALL SELECT o.i, o.q, sha256(o.a || fold.h || o.b) FROM fold JOIN ord o ON o.i = fold.i AND o.q = fold.q + 1)
SELECT k.doc_id, k.leaf, sub.h AS subroot, root.h AS root, coalesce(proof.p, sha256('')) AS proof_sha256,
  z.h AS folded_root, z.h = root.h AS verified
FROM k JOIN sub ON sub.s = k.s CROSS JOIN root LEFT JOIN proof ON proof.i = k.i
JOIN (SELECT i, arg_max(h, q) AS h FROM fold GROUP BY i) z ON z.i = k.i
""".format(**(lambda one: {"fields": ", ".join(one(c) for c in FIELDS[:-1]), "text": one("text"), "other": one("other")})(
    lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"))
