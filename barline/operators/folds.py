"""Combinatorial purged cross-validation as row expressions.

The fold table has C(n, k) rows known when the plan is built, so a handful is a literal array and the
expansion a generator; a larger table is joined by path or by group, with the same rows as result.
Groups are contiguous, so purge and embargo are arithmetic on positions.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LITERAL_PATHS = 1000


def fold_table(n_splits: int = 10, n_test: int = 2) -> list[tuple[int, list[int]]]:
    """All test-group sets in lexicographic order; the index is the path id."""
    if n_splits < 2 or not 1 <= n_test < n_splits:
        raise ValueError("need n_splits >= 2 and 1 <= n_test < n_splits")
    return [(i, list(g)) for i, g in enumerate(combinations(range(n_splits), n_test))]


def fold_combinations(spark: SparkSession, n_splits: int = 10, n_test: int = 2) -> DataFrame:
    return spark.createDataFrame(fold_table(n_splits, n_test), "path_id int, test_groups array<int>")


def with_groups(df: DataFrame, n_splits: int = 10) -> DataFrame:
    """n_bars, group_size and group_id per row; leftover rows join the last group."""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    size = F.floor(n / n_splits).cast("int")
    group = F.least(F.floor(F.col("pos") / F.nullif(size, F.lit(0))), F.lit(n_splits - 1))
    return df.withColumns({"n_bars": n.cast("int"), "group_size": size, "group_id": group.cast("int")})


def group_of(pos: Column, n_splits: int) -> Column:
    return F.least(F.floor(pos / F.col("group_size")), F.lit(n_splits - 1)).cast("int")


def purged_by_horizon(n_splits: int) -> Column:
    """The label span [pos, pos+horizon] touches a test group."""
    end = F.least(F.col("pos") + F.greatest(F.col("horizon"), F.lit(0)), F.col("n_bars") - 1)
    return F.exists("test_groups", lambda g: (g >= F.col("group_id")) & (g <= group_of(end, n_splits)))


def purged_fixed(purge: int) -> Column:
    """Within ``purge`` bars before a test group."""
    p = F.col("pos")
    return F.exists("test_groups", lambda g: (p >= g * F.col("group_size") - purge)
                    & (p < g * F.col("group_size")))


def embargoed(n_splits: int, pct: float) -> Column:
    """Within ceil(pct * n) bars after a test group."""
    p, size = F.col("pos"), F.col("group_size")
    bars = F.ceil(F.lit(pct) * F.col("n_bars"))

    def after(g: Column) -> Column:
        end = F.when(g == n_splits - 1, F.col("n_bars") - 1).otherwise((g + 1) * size - 1)
        return (p > end) & (p <= end + bars)

    return F.exists("test_groups", after)


def expanded(grouped: DataFrame, folds: list[tuple[int, list[int]]], n_splits: int, test_only: bool) -> DataFrame:
    """Each bar with every path, or with the paths that test its group."""
    if len(folds) > LITERAL_PATHS:
        table = grouped.sparkSession.createDataFrame(folds, "path_id int, test_groups array<int>")
        if test_only:
            keyed, key = table.withColumn("group_id", F.explode("test_groups")), "group_id"
        else:
            grouped, keyed, key = grouped.withColumn("path_id", F.explode(F.sequence(F.lit(0), F.lit(len(folds) - 1)))), table, "path_id"
        columns = [c for c in grouped.columns if c != "path_id"]
        return grouped.join(keyed, key).select(*columns, "path_id", "test_groups")

    def literal(rows) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("path_id"),
                                  F.array(*map(F.lit, g)).alias("test_groups")) for i, g in rows])

    mine = F.get(F.array(*[literal([f for f in folds if g in f[1]]) for g in range(n_splits)]), F.col("group_id"))
    out = grouped.withColumn("_f", F.explode(mine if test_only else literal(folds)))
    return out.select(*grouped.columns, "_f.path_id", "_f.test_groups")


def cpcv_split(df: DataFrame, n_splits: int = 10, n_test: int = 2, embargo_pct: float = 0.01,
               purge: int = 10, test_only: bool = False, spread: bool = True) -> DataFrame:
    """One row per bar and path with role train, test or dropped.

    Uses the ``horizon`` column when present, else the fixed purge. Series shorter than
    ``n_splits`` cannot be split and yield no rows. With ``test_only`` each bar expands only into
    the paths that test it, C(n-1, k-1) instead of C(n, k). The expanded rows are spread by
    (symbol, path), so one long series' paths run in parallel instead of behind one symbol key. Where there are many
    series, ``spread=False`` leaves the paths with their series and shuffles no expanded row.
    """
    out = expanded(with_groups(df, n_splits).where("group_size > 0"), fold_table(n_splits, n_test), n_splits, test_only)
    out = out.repartition("symbol", "path_id") if spread else out
    if test_only:
        return out.withColumn("role", F.lit("test"))
    purged = purged_by_horizon(n_splits) if "horizon" in df.columns else purged_fixed(purge)
    role = (F.when(F.array_contains("test_groups", F.col("group_id")), "test")
            .when(purged | embargoed(n_splits, embargo_pct), "dropped").otherwise("train"))
    return out.withColumn("role", role)


def contiguous_blocks(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Runs of consecutive positions as (start, end)."""
    w = Window.partitionBy(*keys).orderBy(pos)
    return (df.withColumn("_island", F.col(pos) - F.row_number().over(w))
            .groupBy(*keys, "_island").agg(F.min(pos).alias("block_start"), F.max(pos).alias("block_end"))
            .drop("_island"))
