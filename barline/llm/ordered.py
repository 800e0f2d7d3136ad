"""Positions and running sums within keys, without a window task per key.

Rows are dealt by range of (key, order), so a key of any size spreads over as many tasks as it needs. Each task numbers
its own rows and writes them; one summary row for each range then tells how much of a range's first key lies in earlier
ranges, and is added when the rows are read again.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written


def _local(batches, keys: list[str], sums: list[str]):
    from pyspark import TaskContext
    part, row, key_no, pos, last = TaskContext.get().partitionId(), 0, -1, 0, object()
    before = [0] * len(sums)
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(batch.schema.get_field_index(s)).to_pylist() for s in sums]
        made = [[] for _ in range(2 + len(sums))]
        for i, key in enumerate(zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys])):
            if key != last:
                key_no, pos, last, before = key_no + 1, 0, key, [0] * len(sums)
            for out, v in zip(made, (key_no, pos, *before)):
                out.append(v)
            pos += 1
            before = [b + v[i] for b, v in zip(before, values)]
        rows = pa.array(range(row, row + batch.num_rows), pa.int64())
        row += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), rows, *[pa.array(m, pa.int64()) for m in made]],
            names=[*batch.schema.names, "_part", "_row", "_key", "_pos", *[f"_before_{s}" for s in sums]])


def keyed_scan(df: DataFrame, keys: list[str], order: list[str], sums: list[str] = (), tag: str = "scan",
               prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows with ``key_no`` (0, 1, ... over the keys in ascending order, null first), ``pos`` (0, 1, ... inside the key
    by ``order``) and ``before_<s>``, the sum of the BIGINT column ``s`` (without nulls) over the key's earlier rows.

    Rows that agree in key and order are told apart by where they were read, so a repeated row of any weight spreads
    too. What reaches the driver, and is broadcast, is one row for each range of rows. ``prepare`` maps rows one to one,
    in order and keeping the keys, once they are dealt: Spark reads a frame twice to deal it by range.
    """
    spark, sums = df.sparkSession, list(sums)
    # As many ranges as input splits, so a range's rows are bounded however the rows are dealt to keys.
    ranges = max(1, df.rdd.getNumPartitions())
    dealt = (df.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys, *order, "_read")
             .sortWithinPartitions(*keys, *order, "_read").drop("_read"))
    df = dealt = prepare(dealt) if prepare else dealt
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_row", T.LongType()),
                           *[T.StructField(c, T.LongType()) for c in ("_key", "_pos", *[f"_before_{s}" for s in sums])]])
    rows = written(dealt.mapInArrow(lambda bs: _local(bs, keys, sums), schema), tag)
    key = F.struct(*keys)
    ends = rows.groupBy("_part").agg(
        F.min_by(key, "_row").alias("first"), F.max_by(key, "_row").alias("last"), (F.max("_key") + 1).alias("keys"),
        F.max_by(F.array(F.col("_pos") + 1, *[F.col(f"_before_{s}") + F.col(s) for s in sums]), "_row").alias("run"))
    carried, at, run, last = [], 0, [0] * (1 + len(sums)), None
    for e in sorted(ends.collect(), key=lambda e: e["_part"]):  # one row for each range
        goes_on = last is not None and e["first"] == last
        add = run if goes_on else [0] * len(run)
        carried.append((e["_part"], at - goes_on, *add))
        at += e["keys"] - goes_on
        run = [a + b for a, b in zip(add, e["run"])] if e["keys"] == 1 else list(e["run"])
        last = e["last"]
    names = ["_pos", *[f"_before_{s}" for s in sums]]
    carry = spark.createDataFrame(carried, ", ".join(["_part int", "_first bigint", *[f"_add{n} bigint" for n in names]]))
    out = rows.join(F.broadcast(carry), "_part")
    return out.select(*df.columns, (F.col("_first") + F.col("_key")).alias("key_no"),
                      *[(F.col(n) + F.when(F.col("_key") == 0, F.col(f"_add{n}")).otherwise(0)).alias(n[1:]) for n in names])
