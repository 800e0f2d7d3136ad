"""Series frames: one window spec for all per-symbol work, with pandas-like null guards.

Bars are daily, so a (symbol) or (symbol, path) partition is bounded by the calendar.
Every builder here takes the same spec, so Spark plans one exchange and one sort per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .columns import col

UNB = Window.unboundedPreceding


def series(*extra: str, order: str = "pos") -> WindowSpec:
    return Window.partitionBy("symbol", *extra).orderBy(order)


def with_pos(df: DataFrame, *keys: str, order: str = "ts") -> DataFrame:
    """Zero-based position within each series."""
    w = Window.partitionBy(*(keys or ("symbol",))).orderBy(order)
    return df.withColumn("pos", (F.row_number().over(w) - 1).cast("int"))


def rolling(fn: Callable[[Column], Column], c, n: int, min_periods: int | None = None,
            w: WindowSpec | None = None) -> Column:
    """``fn`` over the last n rows, NULL until ``min_periods`` (default n) values are present."""
    frame = (w or series()).rowsBetween(-(n - 1), 0)
    x = col(c)
    return F.when(F.count(x).over(frame) >= (n if min_periods is None else min_periods),
                  fn(x).over(frame))


def log_return(c: str = "close", w: WindowSpec | None = None) -> Column:
    x = F.ln(F.when(col(c) > 0, col(c)))
    return x - F.lag(x).over(w or series())


def ffill(c, w: WindowSpec | None = None) -> Column:
    return F.last(col(c), ignorenulls=True).over((w or series()).rowsBetween(UNB, 0))


def bfill(c, w: WindowSpec | None = None) -> Column:
    return F.first(col(c), ignorenulls=True).over(
        (w or series()).rowsBetween(0, Window.unboundedFollowing))


def align_ffill(bars: DataFrame, aux_wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact-date match on the asset calendar, then carry the last matched value forward.

    ``aux_wide`` has one row per calendar date, so it stays small whatever the asset table holds;
    the join strategy is left to the optimizer, which broadcasts it while it fits.
    """
    joined = bars.join(aux_wide.select(F.col("date").alias("ts"), *columns), "ts", "left")
    return joined.withColumns({c: ffill(c) for c in columns})


def complete_cases(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def fill_dead_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """A column with no value at all in a series becomes 0.0 there."""
    whole = Window.partitionBy("symbol")
    return df.withColumns({
        c: F.when(F.count(c).over(whole) == 0, F.lit(0.0)).otherwise(F.col(c)) for c in columns})


def concat_dedup(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union keeping the first frame's row for a repeated key."""
    both = first.withColumn("_src", F.lit(0)).unionByName(second.withColumn("_src", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy("_src")
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_src")


def restrict_to(df: DataFrame, index: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(index.select(*keys), list(keys), "left_semi")


def intersect_index(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, list(keys), "inner")
    return out


def reindex_default(index: DataFrame, df: DataFrame, keys: Sequence[str],
                    defaults: dict[str, float]) -> DataFrame:
    """Rows of ``index`` with the values of ``df``; absent values take the default."""
    out = index.join(df, list(keys), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def tail_rows(df: DataFrame, n: int, order: str = "pos") -> DataFrame:
    """Last n rows of each series."""
    w = Window.partitionBy("symbol").orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def rebase(c, w: WindowSpec | None = None, scale: float = 1.0) -> Column:
    """Divide by the first non-null value of the series."""
    first = F.first(col(c), ignorenulls=True).over((w or series()).rowsBetween(
        UNB, Window.unboundedFollowing))
    return col(c) / first * F.lit(scale)


def every_nth(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("pos") % n == 0)


def runs(df: DataFrame, label: str = "label", keys: Sequence[str] = ("symbol",),
         order: str = "pos") -> DataFrame:
    """Maximal runs of equal labels: start, end, length, next start, and whether it has ended."""
    w = Window.partitionBy(*keys).orderBy(order)
    prev = F.lag(label).over(w)
    change = F.when(prev.isNull() | (prev != F.col(label)), 1).otherwise(0)
    marked = df.withColumn("_change", change).withColumn(
        "run_id", F.sum("_change").over(w.rowsBetween(UNB, 0)))
    out = marked.groupBy(*keys, "run_id").agg(
        F.first(label).alias(label), F.min(order).alias("run_start"),
        F.max(order).alias("run_end"), F.count(F.lit(1)).alias("run_len"))
    nxt = F.lead("run_start").over(Window.partitionBy(*keys).orderBy("run_id"))
    return out.withColumn("next_start", nxt).withColumn("completed", nxt.isNotNull())
