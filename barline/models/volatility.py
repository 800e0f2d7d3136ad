"""Conditional variance as a linear recurrence, its grid fit, and duration models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip
from ..functions.frame import runs
from ..functions.scan import LEAST_BETA, linear_scan
from ..functions.store import stored
from ..schema import ANNUAL_BARS

SCALE = 100.0
ALPHAS = [0.02, 0.05, 0.08, 0.12, 0.16, 0.22, 0.30]
BETAS = [0.50, 0.60, 0.70, 0.78, 0.85, 0.90, 0.94]
#: Spacing of the first fine cells, the spacing below which a series may be done, and rounds at most.
FIRST_STEPS, FINEST, REFINE_ROUNDS, STATIONARY = (0.02, 0.03), 0.002, 16, 0.9995
SHAPES = [round(0.3 + 0.05 * i, 2) for i in range(75)]


def garch_variance(df: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Adds sigma2 (squared percent): omega + alpha * r[t-1]^2 + beta * sigma2[t-1].

    Needs columns omega, alpha, beta and sigma2_0, constant within a series. A block scan, so the
    recursion never leaves the JVM.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    prev = F.lag(F.col("r") * SCALE).over(w)
    df = df.withColumn("_drive", F.when(F.row_number().over(w) == 1, F.col("sigma2_0")).otherwise(
        F.col("omega") + F.col("alpha") * prev * prev))
    return linear_scan(df, {"sigma2": ("_drive", "beta")}, keys).drop("_drive")


def garch_volatility(df: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Conditional volatility in return units."""
    return garch_variance(df, keys).withColumn("sigma", F.sqrt(F.greatest("sigma2", F.lit(0.0))) / SCALE)


def _best(rows: DataFrame, keys: list[str], cells: Column) -> DataFrame:
    """The likeliest of each series' cells (alpha, beta), with omega, last_sigma2 and ll."""
    at = rows.select(*keys, "pos", "r", "_var", "n_train", F.posexplode(cells).alias("cell", "_c")).select(
        *keys, "pos", "r", "n_train", "cell", "_c.alpha", "_c.beta", F.col("_var").alias("sigma2_0"),
        (F.col("_var") * (1 - F.col("_c.alpha") - F.col("_c.beta"))).alias("omega"))
    fitted = garch_variance(at, (*keys, "cell"))
    x2 = F.pow(F.col("r") * SCALE, 2)
    s2 = F.greatest(F.col("sigma2"), F.lit(1e-12))
    point = fitted.groupBy(*keys, "cell", "n_train").agg(
        F.sum(-0.5 * (F.ln(F.lit(2 * math.pi) * s2) + x2 / s2)).alias("ll"), F.max("omega").alias("omega"),
        F.max("alpha").alias("alpha"), F.max("beta").alias("beta"), F.max_by("sigma2", "pos").alias("last_sigma2"))
    return point.groupBy(*keys, "n_train").agg(F.max_by(F.struct("omega", "alpha", "beta", "last_sigma2", "ll"), F.struct(
        "ll", -F.col("cell"))).alias("_b")).select(*keys, "n_train", "_b.*")


def fit_garch(train: DataFrame, keys: tuple[str, ...] = ("symbol",), min_rows: int = 50, rounds: int = REFINE_ROUNDS,
              tolerance: float = 1e-3, reach: int = 2) -> DataFrame:
    """omega, alpha, beta, last_sigma2 and ll per series by maximum likelihood with variance targeting.

    A coarse table of stationary cells finds the region; rounds of cells up to ``reach`` steps around the best point then
    follow it with halving steps, keeping a step while the best cell lies on the rim. A series is done when a round inside its rim gains
    less than ``tolerance``. Cells are generators, so (series, cell) pairs spread over the cluster, and all series share
    a round's job. Series under ``min_rows`` returns are left out; callers fall back to rolling volatility.
    """
    keys = list(keys)
    own = Window.partitionBy(*keys)
    rank = F.row_number().over(own.orderBy("pos")) - 1
    rows = train.where("r IS NOT NULL").select(*keys, rank.alias("pos"), "r", F.count(F.lit(1)).over(own).alias("n_train"),
                                               F.var_pop(F.col("r") * SCALE).over(own).alias("_var"))
    rows = stored(rows.where((F.col("n_train") >= min_rows) & (F.col("_var") > 0)))
    pairs = [(a, b) for a in ALPHAS for b in BETAS if a + b < STATIONARY]
    grid = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta")) for a, b in pairs])
    step = dict(zip(("da", "db"), map(F.lit, FIRST_STEPS)))
    active, ended = stored(_best(rows, keys, grid).withColumns(step)), []
    for _ in range(rounds):
        around = F.array(*[F.struct((F.col("alpha") + i * F.col("da")).alias("alpha"), (F.col("beta") + j * F.col("db")).alias("beta"))
                           for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)])
        inside = F.filter(around, lambda c: (c["alpha"] > 0) & (c["beta"] >= LEAST_BETA) & (c["alpha"] + c["beta"] < STATIONARY))
        before = active.select(*keys, inside.alias("_cells"), F.col("alpha").alias("_a"), F.col("beta").alias("_b"),
                               F.col("ll").alias("_ll"), "da", "db")
        found = _best(rows.join(before.select(*keys, "_cells"), keys), keys, F.col("_cells")).join(before.drop("_cells"), keys)
        edge = reach - 0.5
        rim = (F.abs(F.col("alpha") - F.col("_a")) > edge * F.col("da")) | (F.abs(F.col("beta") - F.col("_b")) > edge * F.col("db"))
        half = F.when(rim, 1.0).otherwise(0.5)
        new = stored(found.select(*keys, "n_train", "omega", "alpha", "beta", "last_sigma2", "ll", (F.col("da") * half).alias("da"),
                                  (F.col("db") * half).alias("db"), (~rim & (F.col("ll") - F.col("_ll") < tolerance) & (
                                      F.col("da") < FINEST)).alias("done")))
        ended.append(new.where("done").drop("done"))
        active = new.where("NOT done").drop("done")
        if active.isEmpty():
            break
    for e in ended:
        active = active.unionByName(e)
    return active.drop("da", "db")


def vol_target_position(sigma: str = "sigma", target: float = 0.14, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Target annual volatility over the forecast, clipped; no forecast or none to speak of gives 0."""
    annual = F.col(sigma) * math.sqrt(ANNUAL_BARS)
    return F.coalesce(clip(F.lit(target) / F.when(annual > 1e-9, annual), lo, hi), F.lit(0.0))


def garch_sigma(rows: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Rows (keys, pos, r, is_train) with sigma: the conditional volatility from a fit on the training rows.

    The recursion starts at the training rows' last variance. Series without a fit take the standard deviation of 21 returns
    (5 at least), the next one before the first, the last one after gaps.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("pos")
    fit = fit_garch(rows.where("is_train"), tuple(keys), reach=1).select(
        *keys, "omega", "alpha", "beta", F.col("last_sigma2").alias("sigma2_0"))
    clean = rows.where("r IS NOT NULL").withColumns({"_at": F.col("pos"), "pos": F.row_number().over(w) - 1})
    known = garch_volatility(clean.join(fit, keys), tuple(keys)).select(*keys, F.col("_at").alias("pos"), "sigma")
    recent = w.rowsBetween(-20, 0)
    rolled = F.when(F.count("r").over(recent) >= 5, F.stddev_samp("r").over(recent))
    out = rows.withColumn("_rolled", rolled).join(known, [*keys, "pos"], "left").withColumn(
        "_any", F.count("sigma").over(Window.partitionBy(*keys)) > 0)
    value = F.when(F.col("_any"), F.col("sigma")).otherwise(F.col("_rolled"))
    filled = F.coalesce(F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                        F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return out.withColumn("sigma", filled).drop("_rolled", "_any")


def fit_durations(labels: DataFrame, label: str = "label", min_runs: int = 3) -> DataFrame:
    """Weibull (shape, scale) of run lengths per state: profile likelihood over a shape grid.

    For a shape k the best scale is the k-mean of durations, so one aggregate per grid point
    suffices. States with few runs get shape 1 and their mean length.
    """
    r = runs(labels, label).select("symbol", label, F.col("run_len").cast("double").alias("d"))
    base = r.groupBy("symbol", label).agg(F.count("d").alias("n_runs"), F.avg("d").alias("_mean"))
    cells = r.select("symbol", label, "d", F.explode(F.array(*map(F.lit, SHAPES))).alias("shape"))
    point = cells.groupBy("symbol", label, "shape").agg(
        F.count("d").alias("_n"), F.avg(F.pow("d", F.col("shape"))).alias("_m"), F.sum(F.ln("d")).alias("_ld"))
    k, n = F.col("shape"), F.col("_n")
    scale = F.pow(F.col("_m"), 1 / k)
    ll = n * F.ln(k) - n * k * F.ln(scale) + (k - 1) * F.col("_ld") - n
    best = point.select("symbol", label, "shape", scale.alias("scale"), ll.alias("ll")).groupBy("symbol", label).agg(
        F.max_by(F.struct("shape", "scale"), "ll").alias("_b"))
    few = F.col("n_runs") < min_runs
    return base.join(best, ["symbol", label]).select(
        "symbol", label, "n_runs", F.when(few, 1.0).otherwise(F.col("_b.shape")).alias("shape"),
        F.when(few, F.greatest("_mean", F.lit(1.0))).otherwise(F.col("_b.scale")).alias("scale"))


def remaining_duration(shape: Column, scale: Column, age: Column, steps: int = 400) -> Column:
    """E[D - d | D > d] for a Weibull: the survival integral beyond d over the survival at d.

    Substituting u = (t / scale)^shape - (d / scale)^shape makes the integrand
    exp(-u) dt/du, summed by the midpoint rule to u = 40. NULL once survival is negligible.
    """
    d = F.greatest(age.cast("double"), F.lit(0.0))
    z = F.pow(d / scale, shape)
    width = 40.0 / steps
    edges = F.sequence(F.lit(0), F.lit(steps))
    at = F.transform(edges, lambda i: scale * F.pow(z + i * width, 1 / shape))
    area = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(0.0), lambda acc, i: acc + F.exp(-(i + 0.5) * width) * (
        F.element_at(at, i + 2) - F.element_at(at, i + 1)))
    return F.when(F.exp(-z) >= 1e-9, area)


