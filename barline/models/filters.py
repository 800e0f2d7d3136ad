"""Hidden-state filters with fixed parameters, and what turns probabilities into positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frame import bfill, ffill, series
from . import chains


def hmm_forward_filter(emissions: DataFrame, trans: list[list[float]], start: list[float]) -> DataFrame:
    """Filtered probabilities from rows (symbol, pos, log_emit array) and fixed parameters."""
    return _by_blocks(emissions, trans, start, chains.filtered).withColumnRenamed("value", "probs")


def likeliest_path(emissions: DataFrame, trans: list[list[float]], start: list[float]) -> DataFrame:
    """The state of each row on the most likely path of its series, for fixed parameters."""
    return _by_blocks(emissions, trans, start, chains.decoded).withColumnRenamed("value", "state")


def _by_blocks(emissions: DataFrame, trans, start, fn) -> DataFrame:
    k = len(start)
    rows = emissions.select(F.col("symbol").alias("model"), F.col("symbol").alias("chain"), "pos", *[
        F.col("log_emit")[i].alias(f"e{i}") for i in range(k)])
    blocks = chains.blocks_of(rows, [f"e{i}" for i in range(k)])
    given = blocks.select("model").distinct().select("model", *[
        F.array(*[F.lit(float(v)) for v in values]).alias(c)
        for c, values in (("trans", [v for row in trans for v in row]), ("start", start))])
    return fn(blocks, given, chains.GIVEN).select(F.col("model").alias("symbol"), "pos", "value")


def fill_probabilities(df: DataFrame, columns: list[str], default: float = 0.5) -> DataFrame:
    """Forward then backward fill, default where a series has none, rows renormalised to 1."""
    out = df.withColumns({c: ffill(c) for c in columns})
    out = out.withColumns({c: F.coalesce(F.col(c), bfill(c), F.lit(default)) for c in columns})
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return out.withColumns({c: F.col(c) / F.when(total > 0, total).otherwise(1.0) for c in columns})


def lagged_position(df: DataFrame, probs: list[str], alloc: tuple[float, ...], lag: int = 1) -> DataFrame:
    """Allocation-weighted probabilities, traded ``lag`` bars later; nothing before that."""
    target = sum((F.col(p) * F.lit(a) for p, a in zip(probs[1:], alloc[1:])), F.col(probs[0]) * F.lit(alloc[0]))
    out = df.withColumn("_target", target)
    position = F.coalesce(F.lag("_target", lag).over(series()) if lag else F.col("_target"), F.lit(0.0))
    return out.withColumn("position", position).drop("_target")


def train_share(df: DataFrame, share: float) -> DataFrame:
    """Marks the leading ``share`` of each series as training rows."""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    return df.withColumn("is_train", F.col("pos") < F.floor(n * share))


