"""WARC records in ZIP packages: written by tasks, read back by range without extraction.

A package is a ZIP file of stored members: ``archive/data.warc.gz``, one gzip member per record, and
``indexes/index.cdx``, one line per record (offset and length in the archive member, key, record type). Packages carry
ZIP64 fields. The reader parses the end of the file, the ZIP64 locator and directory, the central directory and the
members' local headers, finds archive members and their indexes, and reads records by range at
member offset + record offset. Packages of other writers are read alike if their members are stored.

Which records are revisits is decided before writing: payload digests are grouped by a map-side partial aggregate, so a
payload with a third of all rows is one row per task, and pages meet their digest's response in an equi-join.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, written

MIN_BYTES, READ_BYTES, LEVEL = 1000, 8 << 20, 3
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
RECORD_ID = "<urn:page:{}>"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
#: ZIP signatures and 32-bit marks (fixed values of the format).
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF


def _clean(value: object) -> str:
    return "" if value is None else " ".join(str(value).split())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           revisit: bool) -> bytes:
    """One WARC 1.1 record, gzip member of its own; a revisit has no payload but the digest and length of the full one."""
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: {RECORD_ID.format('' if page_id is None else page_id)}", f"WARC-Date: {DATE}",
             f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Refers-To: {RECORD_ID.format('' if refers_to is None else refers_to)}",
                  f"WARC-Profile: {REVISIT}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse_record(member: bytes) -> dict:
    """Headers and payload of a record; lengths and digests are those of the full payload."""
    raw = zlib.decompress(member, 31) if member[:2] == b"\x1f\x8b" else member
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    body = rest[:int(headers["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind = headers["WARC-Type"]

    def page(name: str) -> int | None:
        found = headers.get(name, "")[len("<urn:page:"):-1]
        return int(found) if found else None
    if kind == "response":
        digest, length = hashlib.sha1(payload).hexdigest(), len(payload)
        if f"sha1:{digest}" != headers["WARC-Payload-Digest"]:
            raise ValueError("payload and digest differ")
    return {"page_id": page("WARC-Record-ID"), "url": headers.get("WARC-Target-URI", ""), "record_type": kind,
            "payload_bytes": length, "payload_digest": headers["WARC-Payload-Digest"][len("sha1:"):],
            "refers_to": page("WARC-Refers-To") if kind == "revisit" else None, "payload": payload}


class Package:
    """Directory of a ZIP file behind ``read_at(offset, size)``; entries are (name, offset of the data, size)."""

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        tail_at = max(0, size - 22 - FULL16)
        tail = read_at(tail_at, size - tail_at)
        end = tail.rfind(END)
        if end < 0:
            raise ValueError("no end of central directory")
        _, _, _, _, count, length, start, _ = struct.unpack("<4s4H2IH", tail[end:end + 22])
        if FULL32 in (length, start) or count == FULL16 or tail[end - 20:end - 16] == LOCATOR64:
            at, = struct.unpack("<Q", tail[end - 12:end - 4])
            record = read_at(at, 56)
            if record[:4] != END64:
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack("<3Q", record[32:56])
        self.entries: dict[str, tuple[int, int]] = {}
        directory, at = read_at(start, length), 0
        for _ in range(count):
            if directory[at:at + 4] != CENTRAL:
                raise ValueError("broken central directory")
            method, = struct.unpack("<H", directory[at + 10:at + 12])
            packed, full, names, extras, comment = struct.unpack("<2I3H", directory[at + 20:at + 34])
            local, = struct.unpack("<I", directory[at + 42:at + 46])
            name = directory[at + 46:at + 46 + names].decode()
            packed, local = self._wide(directory[at + 46 + names:at + 46 + names + extras], full, packed, local)
            if method == 0:
                self.entries[name] = (local, packed)
            at += 46 + names + extras + comment

    @staticmethod
    def _wide(extra: bytes, full: int, packed: int, local: int) -> tuple[int, int]:
        """Sizes and offset from the ZIP64 extra field where the 32-bit ones are full."""
        at = 0
        while at + 4 <= len(extra):
            kind, size = struct.unpack("<2H", extra[at:at + 4])
            if kind == 1:
                numbers = iter(struct.unpack(f"<{size // 8}Q", extra[at + 4:at + 4 + size // 8 * 8]))
                if full == FULL32:
                    next(numbers)
                packed = next(numbers) if packed == FULL32 else packed
                local = next(numbers) if local == FULL32 else local
            at += 4 + size
        return packed, local

    def data_at(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many they are."""
        local, size = self.entries[name]
        head = self.read_at(local, 30)
        if head[:4] != LOCAL:
            raise ValueError("broken local header")
        names, extras = struct.unpack("<2H", head[26:30])
        return local + 30 + names + extras, size

    def records(self) -> Iterator[tuple[int, int]]:
        """Absolute (offset, length) of the records of all archive members, from their indexes."""
        for name in self.entries:
            if name.endswith(".cdx"):
                at, size = self.data_at(name)
                rest = b""
                for part_at in range(0, size, READ_BYTES):
                    lines = (rest + self.read_at(at + part_at, min(READ_BYTES, size - part_at))).split(b"\n")
                    rest = lines.pop()
                    for line in lines:
                        offset, length, archive = line.split(b" ")[:3]
                        yield self.start(archive.decode()) + int(offset), int(length)

    def start(self, archive: str) -> int:
        self._starts = getattr(self, "_starts", {})
        if archive not in self._starts:
            self._starts[archive] = self.data_at(archive)[0]
        return self._starts[archive]


def write_packages(pages: DataFrame, path: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as packages, one per partition; returns a row per package: path, records, bytes.

    A package gets its name when it is whole. A task that fails may leave a file ending in ``.part``, or a package that no
    row names when it ran twice; readers open the packages of the rows alone, so neither is read.
    """
    path = path or fresh_path(pages.sparkSession, "warc")
    html = F.coalesce("html", F.lit(""))
    p = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    long_ones = F.octet_length("html") >= min_bytes
    first = (pages.select("page_id", html.alias("html")).where(long_ones)
             .groupBy(F.sha1(F.col("html").cast("binary")).alias("of"))
             .agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times"))
    p = p.join(first, (p.digest == first.of) & long_ones, "left").select(
        "page_id", "url", "html", "digest", "refers_to",
        (F.col("of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))).alias("revisit"))

    def run(batches):
        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        name = f"{base}/{uuid.uuid4().hex}"
        offset, index, lines = 0, [], 0
        sink = zip_file = member = None
        for batch in batches:
            for at in range(batch.num_rows):
                page_id, url, text, digest, refers_to, revisit = [c[at].as_py() for c in batch.columns]
                if zip_file is None:
                    sink = store.open_output_stream(f"{name}.part")
                    zip_file = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                    member = zip_file.open(ARCHIVE, "w", force_zip64=True)
                data = record(page_id, url, text.encode(), digest, refers_to, revisit)
                member.write(data)
                index.append(f"{offset} {len(data)} {ARCHIVE} {'' if page_id is None else page_id} "
                             f"{'revisit' if revisit else 'response'}\n".encode())
                offset, lines = offset + len(data), lines + 1
        if zip_file is None:
            return
        member.close()
        with zip_file.open(INDEX, "w", force_zip64=True) as f:
            f.writelines(index)
        zip_file.close()
        sink.close()
        store.move(f"{name}.part", f"{name}.zip")
        yield pa.RecordBatch.from_arrays([pa.array([f"{name}.zip"]), pa.array([lines]), pa.array([offset])],
                                         names=["package", "records", "bytes"])

    return written(p.mapInArrow(run, "package string, records bigint, bytes bigint"), "packages").withColumn(
        "store", F.lit(path))


def read_packages(packages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Packages (store, package) to a row per record: page_id, url, record_type, payload_bytes, payload_digest,
    refers_to and, if asked for, the payload (empty for revisits)."""
    types = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
             ("payload_digest", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload

    def run(batches):
        for batch in batches:
            for uri, name in zip(*[c.to_pylist() for c in batch.columns]):
                store, _ = fs.FileSystem.from_uri(uri)
                with store.open_input_file(name) as f:
                    window = [0, b""]

                    def read_at(at: int, size: int) -> bytes:
                        f.seek(at)
                        return f.read(size)

                    def near(at: int, size: int) -> bytes:
                        """A range out of a window that moves ahead, so neighbours share a read."""
                        if not window[0] <= at <= at + size <= window[0] + len(window[1]):
                            window[:] = [at, read_at(at, max(size, READ_BYTES))]
                        return window[1][at - window[0]:at - window[0] + size]

                    rows = []
                    for at, size in Package(read_at, f.size()).records():
                        rows.append(parse_record(near(at, size)))
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_pylist([{k: r[k] for k, _ in types} for r in rows],
                                                             pa.schema(types))
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist([{k: r[k] for k, _ in types} for r in rows], pa.schema(types))

    spread = packages.select("store", "package").repartition(max(1, packages.count()))
    names = {"int64": "bigint", "string": "string", "binary": "binary"}
    return spread.mapInArrow(run, ", ".join(f"{k} {names[str(t)]}" for k, t in types))


def archived(pages: DataFrame) -> DataFrame:
    """Pages written to packages and read back: a row per page.

    A null html is an empty payload. A payload of at least ``MIN_BYTES`` that repeats is a response at the largest
    page_id and a revisit elsewhere; rows that repeat that page_id are responses too. A null page_id is never a
    response if another has the payload; if all are null, all are responses. An empty table gives no rows. White space
    in a url is squeezed. Other columns are not read.
    """
    return read_packages(write_packages(pages)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB twin of ``archived``.
SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
           FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= {MIN_BYTES}) AS best FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_BYTES} AND page_id IS DISTINCT FROM best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_BYTES} AND page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM m
"""
