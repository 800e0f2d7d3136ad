"""Structured Streaming forms of the batch operators.

Each function maps a streaming DataFrame to a streaming DataFrame; stateful ones reuse the batch
step, keyed by symbol, so parity with the batch table is testable on the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import scratch, stored
from ..models.classifier import ConformalState
from ..operators import drift
from ..operators.regimes import RegimeState

NO_TIMEOUT = "NoTimeout"
REGIME_OUT = "symbol string, pos int, ts date, p_0 double, p_1 double, p_2 double, label int"
CONFORMAL_OUT = "symbol string, pos int, c_0 double, c_1 double, c_2 double, set_size int, rate double"
CHANGE_OUT = "symbol string, as_of date, from_label int, to_label int"


def run_available(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Process everything available into a Parquet sink (exactly once) and read it back."""
    spark = stream.sparkSession
    base = path or scratch(spark)
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def read_stream(spark: SparkSession, like: DataFrame, path: str, glob: str | None = None, files_per_batch: int = 1) -> DataFrame:
    reader = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


FLUSH = "~end"


def replay(df: DataFrame, order: str, cuts: list[str], transform: Callable[[DataFrame], DataFrame],
           flush: bool = False) -> DataFrame:
    """Land a table in time-ordered slices and run the stream after each from one checkpoint.

    A slice is one micro-batch, so its files may be read in any order; slices never overtake each
    other. Returns everything the sink received. With ``flush`` two rows of a symbol of their own, a
    year and two after the end, move the watermark past it: all windows close and results equal batch.
    """
    spark, base = df.sparkSession, scratch(df.sparkSession)
    kind = df.schema[order].dataType
    edges = [None, *cuts, None]
    df = stored(df)
    parts = []
    for lo, hi in zip(edges, edges[1:]):
        part = df if lo is None else df.where(F.col(order) >= F.lit(lo).cast(kind))
        parts.append(part if hi is None else part.where(F.col(order) < F.lit(hi).cast(kind)))
    if flush:
        end = df.agg(F.max(order).alias(order))
        parts += [end.select(*[(F.col(order) + F.expr(f"INTERVAL {y} YEAR")).cast(kind).alias(f.name) if f.name == order
                               else F.lit(FLUSH if f.name == "symbol" else None).cast(f.dataType).alias(f.name)
                               for f in df.schema.fields]) for y in (1, 2)]
    for part in parts:
        part.write.mode("append").parquet(f"{base}/landing")
        out = run_available(transform(spark.readStream.schema(df.schema).parquet(f"{base}/landing")), base)
    return out.where(F.col("symbol") != FLUSH) if flush else out


def daily_realised(returns: DataFrame, late: str = "1 hour") -> DataFrame:
    """Realised variance and semivariance per symbol and day; a day is emitted once it is closed."""
    r = F.col("r")
    out = returns.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "symbol").agg(
        F.count(r).alias("n"), F.sum(r * r).alias("rv"), F.sum(F.when(r > 0, r * r).otherwise(0.0)).alias("rsv_pos"),
        F.sum(F.when(r < 0, r * r).otherwise(0.0)).alias("rsv_neg"))
    return out.select("symbol", F.to_date("window.start").alias("day"), "n", "rv", "rsv_pos", "rsv_neg")


def live_bars(ticks: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling or sliding OHLCV bars."""
    at = F.struct("ts", "seq")
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return ticks.withWatermark("ts", late).groupBy(window, "symbol").agg(
        F.min_by("close", at).alias("open"), F.max("close").alias("high"), F.min("close").alias("low"),
        F.max_by("close", at).alias("close"), F.count(F.lit(1)).alias("volume")).select(
        "symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def tick_sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of ticks closed by a gap."""
    return ticks.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("close").alias("low"), F.max("close").alias("high")).select(
        "symbol", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "low", "high")


def _ordered(batches: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(by)


def regime_states(inputs: DataFrame) -> DataFrame:
    """Stabilised regimes on a stream of step inputs (see ``regimes.step_inputs``)."""
    def update(key, batches, state):
        last, *held = state.get if state.exists else (-1,)
        s = RegimeState(*held)
        pdf = _ordered(batches, "pos")
        pdf = pdf[pdf["pos"] > last]  # late or replayed bars are no new ones
        if pdf.empty:
            return
        rows = [s.step(sc, v, k, d) for sc, v, k, d in zip(
            pdf[["s_0", "s_1", "s_2"]].to_numpy(), pdf["vol_n"].to_numpy(), pdf["shock"].to_numpy(), pdf["dd"].to_numpy())]
        state.update((int(pdf["pos"].iloc[-1]), int(s.current), int(s.age), int(s.raw), float(s.vol)))
        out = pdf[["symbol", "pos", "ts"]].copy()
        out[["p_0", "p_1", "p_2"]] = np.array([p for p, _ in rows])
        out["label"] = np.array([k for _, k in rows], dtype="int32")
        yield out

    return inputs.groupBy("symbol").applyInPandasWithState(
        update, REGIME_OUT, "last int, current int, age int, raw int, vol double", "append", NO_TIMEOUT)


def conformal_states(probs: DataFrame) -> DataFrame:
    """Adaptive conformal sets on a stream of (symbol, pos, a, b, c, y); state holds at most 500 scores."""
    def update(key, batches, state):
        last, *held = state.get if state.exists else (-1,)
        s = ConformalState(*held)
        pdf, rows = _ordered(batches, "pos"), []
        pdf = pdf[pdf["pos"] > last]
        if pdf.empty:
            return
        for p, y in zip(pdf[["a", "b", "c"]].to_numpy(dtype=float), pdf["y"]):
            inside, cal = s.step(p, None if pd.isna(y) else int(y))
            rows.append((*cal, int(inside.sum()), s.rate))
        state.update((int(pdf["pos"].iloc[-1]), list(map(float, s.scores)), float(s.rate)))
        out = pd.DataFrame(rows, columns=["c_0", "c_1", "c_2", "set_size", "rate"])
        out.insert(0, "symbol", pdf["symbol"].to_numpy())
        out.insert(1, "pos", pdf["pos"].to_numpy())
        yield out.astype({"set_size": "int32"})

    return probs.groupBy("symbol").applyInPandasWithState(
        update, CONFORMAL_OUT, "last int, scores array<double>, rate double", "append", NO_TIMEOUT)


def label_changes(snapshots: DataFrame) -> DataFrame:
    """Label changes per symbol on a stream of (symbol, as_of, label), once per change.

    A replayed snapshot is at or before the stored date and is ignored.
    """
    def update(key, batches, state):
        last, label = state.get if state.exists else (None, None)
        pdf, rows = _ordered(batches, "as_of"), []
        for as_of, k in zip(pdf["as_of"], pdf["label"]):
            day = (pd.Timestamp(as_of) - pd.Timestamp("1970-01-01")).days
            if pd.isna(k) or (last is not None and day <= last):
                continue
            if label is not None and int(k) != label:
                rows.append((key[0], as_of, label, int(k)))
            last, label = day, int(k)
        if last is not None:
            state.update((last, label))
        yield pd.DataFrame(rows, columns=["symbol", "as_of", "from_label", "to_label"]).astype(
            {"from_label": "int32", "to_label": "int32"})

    return snapshots.groupBy("symbol").applyInPandasWithState(
        update, CHANGE_OUT, "last int, label int", "append", NO_TIMEOUT)


def drift_batches(edges: DataFrame, columns: list[str], path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch handler: each micro-batch's counts per column and bin of the stored reference edges.

    Writes to a folder named by the batch id in overwrite mode, so a retried batch replaces itself. Counts add up over
    batches, so the index at any time is that of all rows so far; the reference isn't read again.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        drift.bin_counts(batch, columns, edges).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return handle


def run_drift(stream: DataFrame, edges: DataFrame, columns: list[str], path: str | None = None) -> DataFrame:
    """The stability index of everything that the stream brought, against edges from ``drift.reference_edges``."""
    spark = stream.sparkSession
    base = path or scratch(spark)
    q = (stream.writeStream.foreachBatch(drift_batches(edges, columns, f"{base}/counts"))
         .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return drift.psi_of(edges, spark.read.parquet(f"{base}/counts").drop("batch"))
