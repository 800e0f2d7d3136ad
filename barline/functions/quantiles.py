"""Exact quantiles of large groups without gathering a group into one task.

A bounded sketch cuts each group into brackets; bracket counts locate every wanted order
statistic; only the brackets that hold one are ranked, as distinct values with counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BRACKETS = 1000


def exact_quantiles(df: DataFrame, value: str, key: str, probs: Sequence[float]) -> DataFrame:
    """(key, prob, quantile) with linear interpolation, ``key`` having few distinct values.

    The key table is broadcast: callers pass keys bounded at plan time, such as column names.
    """
    rows = df.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_x"))
    grid = F.expr("array(" + ", ".join(f"{i / BRACKETS!r}D" for i in range(1, BRACKETS)) + ")")
    cuts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"),
                                 F.array_distinct(F.percentile_approx("_x", grid, F.lit(10 * BRACKETS))).alias("_cuts"))
    # bracket i holds cuts[i-1] <= x < cuts[i]
    # binary search over the sorted cut points: how many are <= x
    steps = ", ".join(str(1 << i) for i in reversed(range(BRACKETS.bit_length())))
    place = (f"aggregate(array({steps}), 0, (p, s) -> CASE WHEN p + s <= size(_cuts) "
             "AND get(_cuts, p + s - 1) <= _x THEN p + s ELSE p END)")
    distinct = rows.groupBy(key, "_x").agg(F.count(F.lit(1)).alias("_c"))
    values = distinct.join(F.broadcast(cuts.select(key, "_cuts")), key).select(
        key, "_x", "_c", F.expr(place).alias("_b"))
    sizes = values.groupBy(key, "_b").agg(F.sum("_c").alias("_size"))
    up = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(up), F.lit(0)))

    want = cuts.select(key, "_n", F.explode(F.array(*map(F.lit, probs))).alias("prob"))
    want = want.withColumn("_rank", F.col("prob") * (F.col("_n") - 1))
    want = want.select(key, "prob", (F.col("_rank") - F.floor("_rank")).alias("_frac"), F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.floor("_rank").alias("k")),
        F.struct(F.lit(1).alias("side"), F.ceil("_rank").alias("k")))).alias("_w"))
    want = want.select(key, "prob", "_frac", "_w.side", "_w.k")
    located = want.join(sizes, key).where((F.col("k") >= F.col("_before")) & (F.col("k") < F.col("_before") + F.col("_size")))

    needed = values.join(F.broadcast(located.select(key, "_b").distinct()), [key, "_b"], "left_semi")
    inner = Window.partitionBy(key, "_b").orderBy("_x")
    ranked = needed.withColumn("_upto", F.sum("_c").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    stat = ranked.join(F.broadcast(located), [key, "_b"]).where(
        (F.col("k") - F.col("_before") >= F.col("_upto") - F.col("_c")) & (F.col("k") - F.col("_before") < F.col("_upto")))
    ends = stat.groupBy(key, "prob").agg(
        F.max(F.when(F.col("side") == 0, F.col("_x"))).alias("_lo"), F.max(F.when(F.col("side") == 1, F.col("_x"))).alias("_hi"),
        F.max("_frac").alias("_frac"))
    return ends.select(key, "prob", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")).alias("quantile"))
