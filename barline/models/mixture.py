"""Gaussian regime chains and two-state switching autoregression, fitted by block statistics (``chains``).

Parameters are estimated in standard units of each model's training rows, whose mean and spread stay in the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.store import stored
from . import chains as ch

MIN_MIXTURE_ROWS, MIN_SWITCHING_ROWS = 100, 50


def _scaled(rows: DataFrame, units: DataFrame, x: list[str]) -> DataFrame:
    """Rows (model, chain, pos, x...) in standard units; models without units are dropped."""
    return rows.join(units, "model").select("model", "chain", "pos", *[
        ((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(c) for c in x])


def _units(rows: DataFrame, x: list[str], least: int) -> DataFrame:
    """Mean and spread per model of rows with enough of them; a constant column has spread 1."""
    out = rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in x], *[
        F.stddev_pop(c).alias(f"s_{c}") for c in x]).where(F.col("n") >= least)
    return out.withColumns({f"s_{c}": F.when(F.col(f"s_{c}") > 1e-12, F.col(f"s_{c}")).otherwise(1.0) for c in x})


def _first_states(rows: DataFrame, of: DataFrame, x: list[str]) -> DataFrame:
    """(model, theta) to start from: states are the quantile groups of the last column. ``of`` has model and k."""
    probs = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: i / F.col("k"))
    last, high = rows.select("model", F.col(x[-1]).alias("v")), 10000
    # One sketch per model holds 1/10000 of a rank; the cuts only start the rounds.
    grid = last.groupBy("model").agg(F.percentile_approx("v", F.lit([i / 60 for i in range(61)]), high).alias("grid"))
    cuts = of.join(grid, "model").select("model", "k", F.transform(probs, lambda p: F.element_at(
        "grid", (F.round(p * 60) + 1).cast("int"))).alias("cuts"))
    group = F.aggregate("cuts", F.lit(0), lambda acc, c: acc + (F.col(x[-1]) >= c).cast("int"))
    a, b = x
    per = rows.join(cuts, "model").withColumn("g", group).groupBy("model", "k", "g").agg(
        F.avg(a).alias("a"), F.avg(b).alias("b"), F.var_pop(a).alias("aa"), F.covar_pop(a, b).alias("ab"), F.var_pop(b).alias("bb"))
    found = per.groupBy("model", "k").agg(F.array_sort(F.collect_list(F.struct("g", "a", "b", "aa", "ab", "bb"))).alias("groups"))
    types = pa.schema([("model", pa.string()), ("theta", pa.list_(pa.float64()))])

    def theta(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                k, by = r["k"], {g["g"]: g for g in r["groups"]}
                g = [by.get(i) or r["groups"][-1] for i in range(k)]
                parts = {"means": np.array([[e["a"], e["b"]] for e in g]), "start": np.full(k, 1 / k),
                         "covs": np.array([[[e["aa"], e["ab"]], [e["ab"], e["bb"]]] for e in g]) + ch.RIDGE * np.eye(2),
                         "trans": np.where(np.eye(k, dtype=bool), 0.9, 0.1 / max(k - 1, 1))}
                rows.append({"model": r["model"], "theta": ch.pack(ch.GAUSSIAN, parts)})
            if rows:
                yield ch._arrow(rows, types)
    return found.mapInArrow(theta, "model string, theta array<double>")


def _ordered(theta: list[float]) -> list[float]:
    """States by ascending variance of the last column."""
    p = ch.unpack(ch.GAUSSIAN, theta)
    order = np.argsort(p["covs"][:, -1, -1], kind="stable")
    return ch.pack(ch.GAUSSIAN, {"means": p["means"][order], "covs": p["covs"][order], "trans": p["trans"][np.ix_(order, order)],
                                 "start": p["start"][order]}).tolist()


def _calm_first(theta: list[float]) -> list[float]:
    p = ch.unpack(ch.SWITCHING, theta)
    order = np.argsort(p["s2"], kind="stable")
    return ch.pack(ch.SWITCHING, {"mu": p["mu"][order], "s2": p["s2"][order], "phi": p["phi"], "trans": p["trans"][np.ix_(order, order)],
                                  "start": p["start"][order]}).tolist()


def _sorted_states(fit: DataFrame, order) -> DataFrame:
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("theta")
            yield batch.set_column(at, "theta", pa.array([order(t) for t in batch.column(at).to_pylist()], pa.list_(pa.float64())))
    return fit.mapInArrow(run, fit.schema)


def _model(keys: list[str], *more: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys], *more)


def _pieces(train: DataFrame) -> DataFrame:
    """Training rows (model, pos) with chains that restart at gaps in their positions."""
    rank = F.row_number().over(Window.partitionBy("model").orderBy("pos"))
    return train.withColumn("chain", F.concat_ws("|", "model", (F.col("pos") - rank).cast("string")))


def fit_mixture(rows: DataFrame, ks: DataFrame, iterations: int = 200, tolerance: float = 1e-3, pooled: bool = False) -> DataFrame:
    """Gaussian chains of (r, vol): rows (model, chain, pos, r, vol) and (model, k) to parameters per model.

    Columns: model, theta (standard units, states by ascending vol variance), n, the units, log_likelihood, rounds.
    Models under 100 rows have no row. ``pooled`` as in ``chains.fitted``.
    """
    x = ["r", "vol"]
    units = stored(_units(rows, x, MIN_MIXTURE_ROWS))
    scaled = _scaled(rows, units, x)
    initial = stored(_first_states(scaled, ks.join(units.select("model"), "model"), x))
    fit = ch.fitted(stored(ch.blocks_of(scaled, x)), initial, ch.GAUSSIAN, iterations, tolerance, pooled)
    moved = F.col("n") * (F.ln("s_r") + F.ln("s_vol"))
    return stored(_sorted_states(fit, _ordered).join(units, "model").withColumn("log_likelihood", F.col("log_likelihood") - moved))


def _state_rows(rows: DataFrame, fit: DataFrame, x: list[str], kind: str, decode: bool = False) -> DataFrame:
    blocks = ch.blocks_of(_scaled(rows, fit, x), x)
    return (ch.decoded if decode else ch.filtered)(blocks, fit.select("model", "theta"), kind).withColumnRenamed(
        "value", "state" if decode else "probs")


def regime_mixture(df: DataFrame, k: int = 3, iterations: int = 200, train_only: bool = False, path: bool = False,
                   keys: list[str] = ("symbol",), pooled: bool = False, tolerance: float = 1e-3) -> DataFrame:
    """Filtered p_0..p_{k-1} of a Gaussian chain on (r, vol), states by ascending vol variance.

    One model per ``keys``; ``train_only`` fits on rows with is_train, in chains that restart where rows are left out, and
    filters all rows. Otherwise the fit sees every row, as the snapshot does. ``pooled`` fits one model to all series.
    Models under 100 fitting rows return nothing. ``path`` adds the most likely state sequence.
    """
    keys = list(keys)
    rows = stored(df.select(*keys, "pos", "r", "vol", *(["is_train"] if train_only else [])).withColumn("chain", _model(keys))
                  .withColumn("model", F.lit("all") if pooled else F.col("chain")))
    train = rows.where("is_train").drop("chain") if train_only else rows
    if train_only:
        split = train.withColumn("model_", F.col("model")).withColumn("model", _model(keys))
        train = _pieces(split).withColumn("model", F.col("model_")).drop("model_")
    models = rows.select("model").distinct().withColumn("k", F.lit(k))
    fit = fit_mixture(train, models, iterations, tolerance, pooled)
    out = _state_rows(rows, fit, ["r", "vol"], ch.GAUSSIAN)
    if path:
        out = out.join(_state_rows(rows, fit, ["r", "vol"], ch.GAUSSIAN, decode=True), ["model", "chain", "pos"])
    p = F.col("probs")
    label = F.array_position(p, F.array_max(p)).cast("int") - 1
    named = rows.select("model", "chain", "pos", *keys)
    return named.join(out, ["model", "chain", "pos"]).select(
        *keys, "pos", *[p[i].alias(f"p_{i}") for i in range(k)], label.alias("label"), *(["state"] if path else []))


def select_k(df: DataFrame, k_range: tuple[int, int] = (2, 5), iterations: int = 200) -> DataFrame:
    """AIC and BIC per series and state count; the rounds of all of them are the same jobs."""
    grid = F.explode(F.sequence(F.lit(k_range[0]), F.lit(k_range[1])))
    rows = df.select("symbol", "pos", "r", "vol", grid.alias("k"))
    rows = stored(rows.withColumn("model", _model(["symbol", "k"])).withColumn("chain", F.col("model")))
    ks = rows.select("model", "k", "symbol").distinct()
    fits = fit_mixture(rows, ks.select("model", "k"), iterations).join(ks, "model")
    k, d = F.col("k"), 2
    params = (k - 1) + k * (k - 1) + k * d + k * (d * (d + 1) // 2)
    fits = fits.select("symbol", "k", F.col("n").alias("n_obs"), params.cast("int").alias("n_params"), "log_likelihood")
    ll, p, n = F.col("log_likelihood"), F.col("n_params"), F.col("n_obs")
    out = fits.withColumns({"aic": F.round(-2 * ll + 2 * p, 2), "bic": F.round(-2 * ll + p * F.ln(n), 2)})
    best = F.min_by("k", "bic").over(Window.partitionBy("symbol"))
    return out.withColumn("best_k", best)


def fit_switching(rows: DataFrame, iterations: int = 200, tolerance: float = 1e-6, pooled: bool = False) -> DataFrame:
    """Two-state AR(1) with switching mean and variance: rows (model, chain, pos, v, before) to parameters per model."""
    x = ["v", "before"]
    units = _units(rows, ["v"], MIN_SWITCHING_ROWS)
    # Both values share the units of the newer one, or the model wouldn't stay an autoregression.
    units = stored(units.withColumns({"m_before": F.col("m_v"), "s_before": F.col("s_v")}))
    start = ch.pack(ch.SWITCHING, {"mu": np.zeros(2), "s2": np.array([0.5, 2.0]), "phi": 0.0, "start": np.array([0.5, 0.5]),
                                   "trans": np.array([[0.95, 0.05], [0.05, 0.95]])})
    initial = units.select("model", F.array(*[F.lit(float(v)) for v in start]).alias("theta"))
    fit = ch.fitted(stored(ch.blocks_of(_scaled(rows, units, x), x)), initial, ch.SWITCHING, iterations, tolerance, pooled)
    return stored(_sorted_states(fit, _calm_first).join(units, "model").withColumn(
        "log_likelihood", F.col("log_likelihood") - F.col("n") * F.ln("s_v")))


def switching_ar(df: DataFrame, iterations: int = 200, keys: list[str] = ("symbol",), tolerance: float = 1e-6) -> DataFrame:
    """Filtered p_low, p_high of a two-state AR(1) with switching mean and variance, per ``keys``.

    Fits on is_train rows, in chains that restart where rows are left out, and filters every row with those parameters;
    low is the calmer state. Rows before the second return take the next probabilities, series under 50 training rows 0.5.
    """
    from .filters import fill_probabilities
    keys = list(keys)
    rows = df.select(*keys, "pos", "r", "is_train").withColumn("model", _model(keys))
    rows = stored(rows)
    w = Window.partitionBy("model").orderBy("pos")
    clean = rows.where(F.col("r").isNotNull() & ~F.isnan("r") & (F.abs("r") < float("inf"))).withColumn(
        "step", F.row_number().over(w)).withColumns({"before": F.lag("r").over(w), "v": F.col("r"), "old": F.lag("is_train").over(w)})
    clean = clean.where("before IS NOT NULL")
    # A training step needs both of its returns in the training set; chains restart where steps are left out.
    train = clean.where("is_train AND old").select("model", F.col("step").alias("pos"), "v", "before")
    fit = fit_switching(_pieces(train), iterations, tolerance)
    every = clean.select("model", F.col("model").alias("chain"), "pos", "v", "before")
    p = _state_rows(every, fit, ["v", "before"], ch.SWITCHING).select(
        "model", "pos", F.col("probs")[0].alias("p_low"), F.col("probs")[1].alias("p_high"))
    out = rows.select("model", *keys, "pos").join(p, ["model", "pos"], "left").withColumnRenamed("model", "_model")
    if keys == ["symbol"]:
        return fill_probabilities(out, ["p_low", "p_high"]).drop("_model")
    named = out.withColumnRenamed("symbol", "_symbol").withColumnRenamed("_model", "symbol")
    return fill_probabilities(named, ["p_low", "p_high"]).drop("symbol").withColumnRenamed("_symbol", "symbol")
