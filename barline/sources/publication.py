"""Atomic publication of snapshots: versions, manifests, and a pointer that names the current and the previous one.

A snapshot is written to a folder of its own, then its manifest, then the pointer is replaced by a rename. A version
without a manifest doesn't exist for readers; the pointer only ever names versions with one. So a job that stops between
any two steps leaves the last publication readable, and a job that is run again publishes once: a version of the date that
is current replaces it and keeps the previous one. Rotation is the pointer's second entry; no snapshot is copied.
The coverage gate is judged first: where it fails nothing is written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER, MANIFEST = "CURRENT", "_manifest.json"


class Store:
    """The few small files of a publication, through the file system that Spark uses for the path."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.jvm, self.conf = path.rstrip("/"), spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def read(self, name: str) -> dict | None:
        """A JSON file, None where there is none."""
        at = self._at(name)
        fs = at.getFileSystem(self.conf)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def replace(self, name: str, content: dict) -> None:
        """The file whole under another name, then renamed over the old one."""
        part = self._at(f"{name}.{uuid.uuid4().hex}.part")
        stream = part.getFileSystem(self.conf).create(part, True)
        try:
            stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        finally:
            stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = SparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self.conf).rename(part, self._at(name), options)


def publish(snapshot: DataFrame, gate: DataFrame, path: str, generated_at: str,
            between: Callable[[str], None] = lambda step: None) -> bool:
    """Publish the snapshot of ``generated_at`` if the coverage gate's row allows it; whether it did.

    ``between`` is called after each step with its name (tests stop the job there).
    """
    if not gate.select("publish").first()[0]:
        return False
    spark, version = snapshot.sparkSession, f"{generated_at}-{uuid.uuid4().hex[:12]}"
    store = Store(spark, path)
    snapshot.write.parquet(f"{store.path}/versions/{version}/data")
    between("data")
    rows = spark.read.schema(snapshot.schema).parquet(f"{store.path}/versions/{version}/data").count()
    store.replace(f"versions/{version}/{MANIFEST}", {"generated_at": generated_at, "rows": rows})
    between("manifest")
    now = store.read(POINTER) or {"current": None, "previous": None}
    held = store.read(f"versions/{now['current']}/{MANIFEST}") if now["current"] else None
    again = held is not None and held["generated_at"] == generated_at
    store.replace(POINTER, {"current": version, "previous": now["previous"] if again else now["current"]})
    between("pointer")
    return True


def published(spark: SparkSession, path: str, schema, which: str = "current") -> DataFrame:
    """The current or previous snapshot with its date as ``generated_at``; no rows where there is none.

    Raises if a version's rows aren't those of its manifest.
    """
    store = Store(spark, path)
    version = (store.read(POINTER) or {}).get(which)
    if version is None:
        return spark.createDataFrame([], schema).withColumn("generated_at", F.lit(None).cast("date"))
    held = store.read(f"versions/{version}/{MANIFEST}")
    rows = spark.read.schema(schema).parquet(f"{store.path}/versions/{version}/data")
    if rows.count() != held["rows"]:
        raise ValueError(f"version {version} doesn't hold the {held['rows']} rows of its manifest")
    return rows.withColumn("generated_at", F.lit(held["generated_at"]).cast("date"))
