"""The previous row's values in series of any length, without a task per series.

Rows are dealt by range of (keys, order), so a series with a third of all rows spreads over a third of the tasks. A lag
runs inside a range; a range's first row of a series takes the last value of the nearest earlier range that holds the
series. Those edges are one row for each range and series, of which a range has only one that began in another.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stored


def lag_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Adds ``out: column`` of the previous row by ``order`` inside ``keys``; NULL on a series' first row.

    Without keys the table is one series. The dealt rows are written once, so both uses see the same ranges.
    """
    parts = max(1, df.rdd.getNumPartitions())
    keys, held = list(keys), [F.col(c).alias(o) for o, c in columns.items()]
    dealt = stored(df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()))
    ends = dealt.groupBy("_range", *keys).agg(F.max_by(F.struct(*held), F.struct(*order)).alias("_end"))
    # At most one row for each range and series enters these windows.
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range")
    edges = ends.select("_range", *[F.col(k).alias(f"_k_{k}") for k in keys], F.lag("_end").over(earlier).alias("_edge"))
    inside = Window.partitionBy("_range", *keys).orderBy(*order)
    rows = dealt.withColumns({"_nth": F.row_number().over(inside), "_prev": F.lag(F.struct(*held)).over(inside)})
    same = rows["_range"] == edges["_range"]
    for k in keys:
        same &= rows[k].eqNullSafe(edges[f"_k_{k}"])
    value = F.when(F.col("_nth") == 1, F.col("_edge")).otherwise(F.col("_prev"))
    return rows.join(edges, same, "left").select(*[rows[c] for c in df.columns], *[value[o].alias(o) for o in columns])
