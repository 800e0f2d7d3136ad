"""Strategies that fit on each path's train rows and trade its train and test rows.

A strategy maps the fold view (symbol, path_id, role train or test, pos, ts, r, features) to positions. Those that model
states first map it to probabilities: ``(view) -> (symbol, path_id, pos, p...)``, estimated on train rows, filtered over
train and test rows in time order. One job fits all series and paths: a model is a (symbol, path), its chains restart where
purged rows are missing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from threading import Lock

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.store import stored
from ..models import boosting as bo
from ..models import mixture as mix
from ..models import volatility as vol
from ..operators import labels as lab
from ..operators import regimes as rg
from .validation import CELL, Strategy

PATH = ["symbol", "path_id"]
Probabilities = Callable[[DataFrame], DataFrame]
# The published settings of the transition detector.
GATE_ROUNDS, GATE_DEPTH, GATE_HORIZON = 80, 4, 5


def _training(view: DataFrame, *columns: str) -> DataFrame:
    return view.select(*PATH, "pos", *columns, (F.col("role") == "train").alias("is_train"))


def once(probabilities: Probabilities) -> Probabilities:
    """The same for several strategies: fitted and written once for each view."""
    known: dict[int, tuple[DataFrame, DataFrame]] = {}
    lock = Lock()

    def run(view: DataFrame) -> DataFrame:
        with lock:
            if id(view) not in known:
                known.clear()
                known[id(view)] = view, stored(probabilities(view))
            return known[id(view)][1]
    return run


def switching_probabilities(view: DataFrame) -> DataFrame:
    """p_low, p_high of a two-state switching autoregression of returns."""
    return mix.switching_ar(_training(view, "r"), keys=PATH, tolerance=1e-3).select(*PATH, "pos", "p_low", "p_high")


def mixture_probabilities(k: int, vol_column: str = "vol_ewma") -> Probabilities:
    """p_0..p_{k-1} of a Gaussian chain on returns and volatility, calm states first; absent values count as 0."""
    def fit(view: DataFrame) -> DataFrame:
        zero = F.lit(0.0)
        rows = _training(view.select(*PATH, "pos", "role", F.coalesce("r", zero).alias("r"), F.coalesce(vol_column, zero).alias("vol")),
                         "r", "vol")
        return mix.regime_mixture(rows, k, train_only=True, keys=PATH).drop("label")
    return fit


def allocated(probabilities: Probabilities, columns: Sequence[str], weights: Sequence[float], lag: int) -> Strategy:
    """Positions from weighted probabilities, traded ``lag`` rows later; 0 without probabilities."""
    def run(view: DataFrame) -> DataFrame:
        target = sum((F.col(c) * w for c, w in zip(columns[1:], weights[1:])), F.col(columns[0]) * weights[0])
        w = Window.partitionBy(*PATH).orderBy("pos")
        p = probabilities(view).withColumn("_t", target)
        p = p.select(*PATH, "pos", (F.lag("_t", lag).over(w) if lag else F.col("_t")).alias("_t"))
        return view.select(*CELL).join(p, [*PATH, "pos"], "left").select(*CELL, F.coalesce("_t", F.lit(0.0)).alias("position"))
    return run


def fusion_probabilities(label: str = "rule_label", switching: Probabilities = switching_probabilities) -> Probabilities:
    """A three-state chain pooled with the switching states, lifted to classes by the train rows' rule labels."""
    def fit(view: DataFrame) -> DataFrame:
        both = mixture_probabilities(3)(view).join(switching(view), [*PATH, "pos"])
        rows = stored(both.join(view.select(*PATH, "pos", "role", label), [*PATH, "pos"]).withColumns(
            {"_symbol": F.col("symbol"), "symbol": F.concat_ws("#", "symbol", F.col("path_id").cast("string"))}))
        mapping = rg.state_mapping(rows.where("role = 'train'").withColumn("label", F.col(label)))
        return rg.fuse(rows, mapping).select(F.col("_symbol").alias("symbol"), "path_id", "pos", "fusion_p0", "fusion_p1", "fusion_p2")
    return fit


def garch_target(target: float = 0.14) -> Strategy:
    """Variance targeting with a volatility fitted on the train rows."""
    def run(view: DataFrame) -> DataFrame:
        sigma = vol.garch_sigma(_training(view, "r"), tuple(PATH)).select(*PATH, "pos", "sigma")
        return view.select(*CELL).join(sigma, [*PATH, "pos"]).select(*CELL, vol.vol_target_position("sigma", target).alias("position"))
    return run


def change_probabilities(view: DataFrame, features: Sequence[str], label: str = "rule_label") -> DataFrame:
    """p_change per row: boosted trees of the train rows tell a label change within the horizon; 0.5 without a model."""
    rows = stored(bo.binned(view.withColumn("model", F.concat_ws("#", "symbol", F.col("path_id").cast("string"))), features,
                            bo.bin_edges(view.where("role = 'train'"), features)).select(*PATH, "pos", "role", "model", "bins", label))
    train = rows.where("role = 'train'").select(F.col("model").alias("symbol"), "pos", "bins", label)
    train = lab.transition_target(train, label, GATE_HORIZON).where("in_fit").withColumnRenamed("symbol", "model")
    share = train.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("hits")).where(
        "n >= 30 AND hits > 0 AND hits < n")
    heavy = F.least(F.greatest((F.col("n") - F.col("hits")) / F.col("hits"), F.lit(1.0)), F.lit(50.0))
    weighted = train.join(share, "model").select("model", "bins", F.col("target").cast("int").alias("y"),
                                                 F.when(F.col("target") == 1, heavy).otherwise(1.0).alias("w"))
    fits = bo.fit_models(weighted, 2, rounds=GATE_ROUNDS, depth=GATE_DEPTH)
    p = bo.predict(rows.select(*PATH, "pos", "model", "bins"), fits, 2, (GATE_ROUNDS,), "_q")
    p = p.select(*PATH, "pos", F.col("_q")[0][1].alias("p_change"))
    return rows.select(*PATH, "pos").join(p, [*PATH, "pos"], "left").withColumn("p_change", F.coalesce("p_change", F.lit(0.5)))


def transition_gated(features: Sequence[str], label: str = "rule_label", rule: Sequence[str] = S.FEATURES_V1) -> Strategy:
    """The stabilised rule's positions, damped by the chance of a regime change."""
    def run(view: DataFrame) -> DataFrame:
        p = change_probabilities(view, features, label)
        return rg.rule_positions(view, rule).join(p, [*PATH, "pos"]).select(*CELL, rg.gated_position("position", "p_change").alias("position"))
    return run


def fitted_strategies(features: Sequence[str] = S.FEATURES_V1) -> dict[str, Strategy]:
    """The fitted members of the panel by name; the view needs the rule's features, ``rule_label`` and its p_0..p_2."""
    switching = once(switching_probabilities)
    return {"switching_ar": allocated(switching, ["p_low", "p_high"], S.SWITCHING_ALLOC, 1),
            "duration_hmm": allocated(mixture_probabilities(4), [f"p_{i}" for i in range(4)], S.K4_ALLOC, 0),
            "garch_target": garch_target(),
            "fusion": allocated(fusion_probabilities(switching=switching), ["fusion_p0", "fusion_p1", "fusion_p2"], S.K3_ALLOC, 1),
            "transition_gated": transition_gated([*features, "p_0", "p_1", "p_2"])}
