"""Distribution drift between a reference and a current table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ColumnOrName, col, finite_or_null
from ..functions.quantiles import exact_quantiles
from ..functions.store import stored

PSI_THRESHOLD, MMD_THRESHOLD, CALIBRATION_THRESHOLD = 0.25, 0.10, 0.05
FLOOR = 1e-4
#: Rows whose features are formed at once.
SLICE = 1024


def _long(df: DataFrame, columns: Sequence[str], side: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), finite_or_null(c).alias("x")) for c in columns])
    return df.select(F.lit(side).alias("side"), F.inline(cells)).where("x IS NOT NULL")


def reference_edges(reference: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """(column, n_edges, inner_edges, bins, counts): the reference's quantile edges and its own counts per bin.

    Edges are exact quantiles with duplicates removed and open outer ends. One row per column: a table to be stored once for
    each version of the reference, which later batches read in its place.
    """
    ref = _long(reference, columns, "ref")
    edges = exact_quantiles(ref, "x", "column", [i / bins for i in range(bins + 1)]).groupBy("column").agg(
        F.array_sort(F.collect_set("quantile")).alias("edges"))
    edges = edges.select("column", F.size("edges").alias("n_edges"),
                         F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0))).alias("inner_edges"))
    counts = bin_counts(reference, columns, edges).groupBy("column").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("counts"))
    return edges.join(F.broadcast(counts), "column").withColumn("bins", F.lit(bins))  # a row per column


def bin_counts(df: DataFrame, columns: Sequence[str], edges: DataFrame) -> DataFrame:
    """(column, bin, n) of a table or batch, by the reference's edges: counts that add up over batches."""
    placed = _long(df, columns, "cur").join(F.broadcast(edges.select("column", "inner_edges")), "column").select(
        "column", F.expr("size(filter(inner_edges, e -> x >= e))").alias("bin"))
    return placed.groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))


def psi_of(edges: DataFrame, current: DataFrame) -> DataFrame:
    """The index per column from stored edges and any number of (column, bin, n) counts.

    Under ``bins`` rows on a side it is NULL; a near-constant reference gives 0.
    """
    ref = edges.select("column", F.explode("counts").alias("bin", "r"))
    cur = current.groupBy("column", "bin").agg(F.sum("n").alias("c"))
    counts = ref.join(cur, ["column", "bin"], "full").select("column", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("c", F.lit(0)).alias("c"))
    totals = counts.groupBy("column").agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"))
    # empty bins on both sides contribute nothing: equal floors cancel
    joined = counts.join(F.broadcast(totals), "column").join(F.broadcast(edges.select("column", "n_edges", "bins")), "column")
    r = F.greatest(F.col("r") / F.greatest(F.col("n_ref"), F.lit(1)), F.lit(FLOOR))
    c = F.greatest(F.col("c") / F.greatest(F.col("n_cur"), F.lit(1)), F.lit(FLOOR))
    out = joined.groupBy("column", "n_edges", "bins", "n_ref", "n_cur").agg(F.sum((c - r) * F.ln(c / r)).alias("_psi"))
    few = (F.col("n_ref") < F.col("bins")) | (F.col("n_cur") < F.col("bins"))
    return out.select("column", "n_ref", "n_cur",
                      F.when(few, None).when(F.col("n_edges") < 3, 0.0).otherwise(F.col("_psi")).alias("psi"))


def psi(reference: DataFrame, current: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Population stability index per column over the reference's quantile bins; see ``reference_edges`` and ``psi_of``."""
    edges = stored(reference_edges(reference, columns, bins))
    return psi_of(edges, bin_counts(current, columns, edges))


def median_distance(df: DataFrame, vector: str, id_column: str, buckets: int = 4096) -> float:
    """Median squared distance over as many pairs as there are rows: each row and the next one of its hash bucket.

    The pairing is a hash order of ids inside hash buckets, so every row takes part and no bucket holds a fixed share of
    the table; the median is a bounded sketch. One number reaches the driver; 1 where there is no pair.
    """
    h = F.xxhash64(id_column)
    w = Window.partitionBy(F.pmod(h, F.lit(buckets))).orderBy(F.xxhash64(F.lit(1), id_column), id_column)
    rows = df.where(F.col(vector).isNotNull()).select(vector, F.lead(vector).over(w).alias("_next")).where("_next IS NOT NULL")
    apart = F.aggregate(F.zip_with(vector, "_next", lambda a, b: (a - b).cast("double") * (a - b).cast("double")), F.lit(0.0),
                        lambda acc, x: acc + x)
    found = rows.select(apart.alias("_d")).where("_d > 1e-12").agg(F.percentile_approx("_d", 0.5, F.lit(10_000))).first()[0]
    return float(found) if found else 1.0


def mmd_rbf(reference: DataFrame, current: DataFrame, vector: str, id_column: str, dim: int, features: int = 1024) -> DataFrame:
    """Squared discrepancy under an RBF kernel whose bandwidth is the median squared distance, over whole tables."""
    both = reference.select(vector, id_column).unionByName(current.select(vector, id_column))
    return mmd_fourier(reference, current, vector, dim, median_distance(both, vector, id_column), features)


def fourier_sums(batches: Iterator[pd.DataFrame], w: np.ndarray, b: np.ndarray) -> Iterator[pd.DataFrame]:
    """Per side of (side, v) rows: their number and the sum of each feature, once for a task.

    Features are formed for ``SLICE`` rows at a time, so what a task holds doesn't depend on the batch size.
    """
    n, sums = {}, {}
    for pdf in batches:
        for at in range(0, len(pdf), SLICE):
            part = pdf.iloc[at:at + SLICE]
            for side, group in part.groupby("side"):
                z = np.array(group["v"].tolist(), dtype=float) @ w
                z += b
                n[side] = n.get(side, 0) + len(group)
                sums[side] = sums.get(side, 0.0) + np.cos(z, out=z).sum(0) * np.sqrt(2.0 / len(b))
    for side in n:
        yield pd.DataFrame({"side": int(side), "n": n[side], "i": np.arange(len(b)), "z": sums[side]})


def mmd_fourier(reference: DataFrame, current: DataFrame, vector: str, dim: int, scale: float,
                features: int = 256, seed: int = 42) -> DataFrame:
    """The same discrepancy over whole tables: random Fourier features averaged per side.

    Each task is reduced to one sum vector a side before the shuffle; what crosses is bounded by tasks.
    """
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=np.sqrt(2.0 / scale), size=(dim, features))
    b = rng.uniform(0, 2 * np.pi, size=features)

    rows = [d.where(F.col(vector).isNotNull()).select(F.lit(s).alias("side"), F.col(vector).cast("array<double>").alias("v"))
            for s, d in ((0, reference), (1, current))]
    sums = rows[0].unionByName(rows[1]).mapInPandas(lambda batches: fourier_sums(batches, w, b), "side int, n long, i int, z double")
    mean = sums.groupBy("i").agg(*[
        (F.sum(F.when(F.col("side") == s, F.col("z"))) / F.nullif(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0))).alias(f"m{s}")
        for s in (0, 1)])
    return mean.agg(F.sum(F.pow(F.col("m0") - F.col("m1"), 2)).alias("mmd2"))


def calibration_drift(reference: ColumnOrName, current: ColumnOrName, target: ColumnOrName) -> Column:
    """Positive when coverage moved away from its target."""
    t = col(target)
    return F.abs(col(current) - t) - F.abs(col(reference) - t)


def drift_check(psi_table: DataFrame, mmd: DataFrame, cal: DataFrame | None = None) -> DataFrame:
    """One row: worst PSI, MMD, worst calibration drift (``cal_drift`` of ``cal``) and the breached thresholds."""
    worst = [psi_table.agg(F.max("psi").alias("psi_max")), mmd.agg(F.max(finite_or_null("mmd2")).alias("mmd2")),
             *([] if cal is None else [cal.agg(F.max("cal_drift").alias("cal_drift"))])]
    out = worst[0].withColumn("_one", F.lit(1))
    for one in worst[1:]:  # one-row tables
        out = out.join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one")
    out = out.drop("_one") if cal is not None else out.drop("_one").withColumn("cal_drift", F.lit(None).cast("double"))

    def breach(c: str, limit: float) -> Column:
        return F.when(F.col(c) >= limit, F.format_string(f"{c}=%.3f>={limit}", F.col(c)))

    triggers = F.array_compact(F.array(breach("psi_max", PSI_THRESHOLD), breach("mmd2", MMD_THRESHOLD),
                                       breach("cal_drift", CALIBRATION_THRESHOLD)))
    return out.withColumn("triggers", triggers).withColumn("triggered", F.size("triggers") > 0)
