"""Helpers shared by the operators of this subpackage: shared scratch tables, words, row wrapping."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs free of ASCII white space (space, tab, line feed, vertical tab, form feed, carriage return).
WORD = re.compile("[^\x20\x09-\x0D]+")

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only a session on one machine without one gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.conf.get("spark.app.id", "app")
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="barline-llm-")
    return _OWN[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/llm/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The frame as a table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wrapped(df: DataFrame, **derived) -> DataFrame:
    """The whole row as one struct ``row`` beside derived columns, so no column of the input can clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                     *[c.alias(k) for k, c in derived.items()])


def per_row(df: DataFrame, schema: str, make: Callable[[], Callable], rows: int = 256, keep: int = 0,
            field: str | None = None, done: Callable[[], None] | None = None) -> DataFrame:
    """Apply a function of column lists to slices of at most ``rows`` rows of each Arrow batch.

    ``make`` runs once per task and returns ``fn(*columns) -> tuple of columns`` in the order of ``schema``. The slices
    bound what a task holds beside the batch itself when texts are very long. The first ``keep`` columns are handed on
    as they are, before those of ``schema``; ``fn`` then must return a value for each row. ``field`` names a field of the
    first column, a struct, that ``fn`` gets first: a text inside a wrapped row needs no second copy beside it. ``done``
    runs at the end of a task, to let go of what the worker would keep.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema
    made = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                inner = [part.column(0).field(field)] if field else []
                out = fn(*[c.to_pylist() for c in [*inner, *part.columns[keep:]]])
                new = [pa.array(v, t) for v, t in zip(out, arrow.types)]
                yield pa.RecordBatch.from_arrays([*part.columns[:keep], *new], names=[*batch.schema.names[:keep],
                                                                                      *arrow.names])
                del part, inner, out, new
            del batch  # else it stays while the next one is read
        if done:
            done()
        pa.default_memory_pool().release_unused()  # the worker is kept for other tasks

    return df.mapInArrow(run, T.StructType([*df.schema.fields[:keep], *made.fields]))
