"""Token-id files with a minimal perfect hash index.

A set is a folder: ``ids/<shard>.bin`` holds the raw ids of its documents one after another (little-endian, 16 bits
where the vocabulary allows, else 32; each document ends with the end id), shards and documents in ascending doc_id
order; ``index/<bucket>.mph`` finds a document's place in constant time. A key's bucket is its hash modulo the number
of buckets; inside a bucket a minimal perfect hash (levels of bit arrays with ranks) gives the key's slot, and the slot
holds a 32-bit fingerprint that rejects foreign keys, the shard, the offset and the length. A key is a doc_id and its
occurrence number, 0 unless ids repeat.

Texts are shuffled once by range of doc_id; each task encodes its range and writes one shard under a temporary name,
renamed when whole, so a repeated task leaves the same file. Index entries (some thirty bytes a document) are dealt to
buckets of about ``BUCKET_KEYS`` keys and hashed there.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, written
from .words import id_cache, split_words, tokenizer

END_ID, BUCKET_KEYS, GAMMA, LEVELS = 1, 32_768, 2.0, 48
MAGIC = b"BLMPH001"
SLOT = np.dtype([("fp", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u8")])


def put(path: str, data: bytes) -> None:
    """Write a file of the shared folder: whole or not at all."""
    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex[:8]}.part"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, name)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _at(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(h1 + np.uint64(level) * (h2 | np.uint64(1))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys, (h1, h2) as arrays of 64-bit numbers."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.ranks, base = levels, [], 0
        for bits in levels:
            counts = np.cumsum(bits)
            self.ranks.append(base + np.concatenate([[0], counts[:-1]]))
            base += int(counts[-1])

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> "PerfectHash":
        levels = []
        while len(h1):
            if len(levels) == LEVELS:
                raise ValueError("keys repeat")
            size = max(64, int(GAMMA * len(h1)))
            at = _at(h1, h2, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = ~alone[at]
            h1, h2 = h1[left], h2[left]
        return cls(levels)

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """A slot for each key; -1 for keys surely not in the set, any slot for other foreign keys."""
        out = np.full(len(h1), -1, dtype=np.int64)
        open_ = np.arange(len(h1))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            at = _at(h1[open_], h2[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return out

    def dump(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + b"".join(
            struct.pack("<Q", len(b)) + np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def load(cls, f: io.BytesIO) -> "PerfectHash":
        levels = []
        for _ in range(struct.unpack("<I", f.read(4))[0]):
            size, = struct.unpack("<Q", f.read(8))
            levels.append(np.unpackbits(np.frombuffer(f.read(-(-size // 8)), np.uint8), count=size).astype(bool))
        return cls(levels)


def hashes(key: F.Column, nth: F.Column) -> list[F.Column]:
    return [F.xxhash64(key, nth).alias("h1"), F.xxhash64(F.lit("second"), key, nth).alias("h2")]


def _u64(s) -> np.ndarray:
    return np.asarray(s, dtype=np.int64).view(np.uint64)


def _fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (_mix(h2 ^ h1 >> np.uint64(7)) >> np.uint64(32)).astype("<u4")


def write_shards(docs: DataFrame, path: str, model: str, end_id: int) -> tuple[DataFrame, str]:
    """Encode and write the payload; returns a row per document (doc_id, nth, shard, offset, n) and the id type."""
    typecode = "H" if tokenizer(model).get_vocab_size() <= 1 << 16 else "I"
    width = {"H": 2, "I": 4}[typecode]
    end = end_id.to_bytes(width, "little")

    def run(batches):
        from pyspark import TaskContext
        shard, cache = TaskContext.get().partitionId(), id_cache(model, typecode)
        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(f"{base}/ids", recursive=True)
        name, part = f"{base}/ids/{shard:07d}.bin", f"{base}/ids/{shard:07d}.{uuid.uuid4().hex[:8]}.part"
        offset, last, nth = 0, object(), 0
        with store.open_output_stream(part) as f:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    ids, texts = [c.to_pylist() for c in batch.slice(at, 256).columns]
                    rows = []
                    for key, text in zip(ids, texts):
                        data = b"".join(cache.take(split_words(text or ""))) + end
                        f.write(data)
                        nth, last = (nth + 1 if key == last else 0), key
                        rows.append((key, nth, shard, offset, len(data) // width))
                        offset += len(data) // width
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64(),
                                                                      pa.int64()))],
                        names=["doc_id", "nth", "shard", "offset", "n"])
        store.move(part, name)

    shards = max(1, docs.rdd.getNumPartitions())
    ordered = (docs.select("doc_id", "text").repartitionByRange(shards, "doc_id")
               .sortWithinPartitions("doc_id", F.xxhash64("text")))
    return ordered.mapInArrow(run, "doc_id bigint, nth bigint, shard int, offset bigint, n bigint"), typecode


def write_set(docs: DataFrame, model: str, path: str | None = None, end_id: int = END_ID) -> dict:
    """Write documents as a token set; returns what a reader needs: path, id type, buckets, and the shards' totals.

    Null texts are empty documents (the end id alone). Null ids come first and are keys like others; repeated ids are
    told apart by occurrence, ordered by a hash of the text. An empty table gives a set without keys.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    rows, typecode = write_shards(docs, path, model, end_id)
    entries = written(rows, "entries")
    totals = written(entries.groupBy("shard").agg(F.sum("n").alias("n_ids"), F.count(F.lit(1)).alias("n_docs")), "totals")
    buckets = max(1, -(-(totals.agg(F.sum("n_docs")).first()[0] or 0) // BUCKET_KEYS))
    keyed = entries.select("shard", "offset", "n", *hashes(F.col("doc_id"), F.col("nth"))).withColumn(
        "bucket", F.pmod("h1", F.lit(buckets)).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = _u64(pdf.h1), _u64(pdf.h2)
        mph = PerfectHash.build(h1, h2)
        table = np.zeros(len(pdf), SLOT)
        at = mph.slots(h1, h2)
        for field, values in (("fp", _fingerprint(h1, h2)), ("shard", pdf["shard"]), ("offset", pdf["offset"]),
                              ("n", pdf["n"])):
            table[field][at] = np.asarray(values)
        bucket = int(pdf.bucket.iloc[0])
        put(f"{path}/index/{bucket:07d}.mph", MAGIC + mph.dump() + table.tobytes())
        return pd.DataFrame({"bucket": [bucket], "keys": [len(pdf)]})

    written(keyed.groupBy("bucket").applyInPandas(build, "bucket int, keys bigint"), "buckets")
    return {"path": path, "typecode": typecode, "buckets": buckets, "totals": totals}


def load_bucket(path: str, bucket: int) -> tuple[PerfectHash, np.ndarray]:
    store, base = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{base}/index/{bucket:07d}.mph") as f:
        data = f.read()
    if data[:8] != MAGIC:
        raise ValueError("not an index file")
    f = io.BytesIO(data[8:])
    mph = PerfectHash.load(f)
    return mph, np.frombuffer(f.read(), SLOT)


def locate(keys: DataFrame, token_set: dict) -> DataFrame:
    """Keys (doc_id, nth) with shard, offset and n from the index; foreign keys have nulls there."""
    path = token_set["path"]
    keyed = keys.select("doc_id", "nth", *hashes(F.col("doc_id"), F.col("nth"))).withColumn(
        "bucket", F.pmod("h1", F.lit(token_set["buckets"])).cast("int"))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = _u64(pdf.h1), _u64(pdf.h2)
        mph, table = load_bucket(path, int(pdf.bucket.iloc[0]))
        at = mph.slots(h1, h2)
        got = table[np.maximum(at, 0)] if len(table) else np.zeros(len(pdf), SLOT)
        known = (at >= 0) & (len(table) > 0) & (got["fp"] == _fingerprint(h1, h2))
        out = pdf[["doc_id", "nth"]].copy()
        for c in ("shard", "offset", "n"):
            out[c] = pd.Series(got[c].astype(np.int64), index=out.index, dtype="Int64").where(known, pd.NA)
        return out

    return keyed.groupBy("bucket").applyInPandas(
        find, "doc_id bigint, nth bigint, shard bigint, offset bigint, n bigint")


def read_ids(places: DataFrame, token_set: dict, make: dict, schema: str) -> DataFrame:
    """Read the ids of located documents from the payload: columns of ``make`` (name to function of an id array).

    The documents of a shard are read in one pass over its file, in order of their offsets.
    """
    path, dtype = token_set["path"], {"H": np.dtype("<u2"), "I": np.dtype("<u4")}[token_set["typecode"]]

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        store, base = fs.FileSystem.from_uri(path)
        pdf = pdf.sort_values("offset")
        made: dict[str, list] = {k: [] for k in make}
        with store.open_input_file(f"{base}/ids/{int(pdf['shard'].iloc[0]):07d}.bin") as f:
            for offset, n in zip(pdf["offset"], pdf["n"]):
                f.seek(int(offset) * dtype.itemsize)
                ids = np.frombuffer(f.read(int(n) * dtype.itemsize), dtype)
                for k, fn in make.items():
                    made[k].append(fn(ids))
        return pdf[["doc_id", "nth", "shard", "offset"]].assign(**made)

    return places.groupBy("shard").applyInPandas(
        read, f"doc_id bigint, nth bigint, shard bigint, offset bigint, {schema}")


def digests(docs: DataFrame, token_set: dict) -> DataFrame:
    """Per document, read back through the index: doc_id, start, n_tokens, ids_crc32."""
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))
    keys = again.select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("times") - 1)).alias("nth"))
    got = read_ids(locate(keys, token_set), token_set, {
        "n_tokens": len, "ids_crc32": lambda ids: zlib.crc32(ids.astype("<u4").tobytes())},
        "n_tokens bigint, ids_crc32 bigint")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard file
    base = token_set["totals"].select(F.col("shard").cast("bigint").alias("file"), F.coalesce(
        F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return got.join(base, got["shard"] == base["file"]).select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
