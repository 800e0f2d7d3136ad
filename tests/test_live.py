from pyspark.sql import functions as F

from barline.operators import realised
from barline.operators import regimes as rg
from barline.sources import sinks
from barline.sources.readers import read_closes
from barline.streaming import live

INPUTS = "symbol string, pos int, ts date, s_0 double, s_1 double, s_2 double, vol_n double, shock double, dd double"


def landed(spark, df, path, order):
    for i, part in enumerate(df.randomSplit([1.0]) if order is None else order(df)):
        part.coalesce(1).write.mode("append").parquet(path)
    return live.read_stream(spark, df, path)


def test_stream_regimes_equal_batch(spark, tmp_path):
    df = spark.range(160).select(
        F.lit("A").alias("symbol"), F.col("id").cast("int").alias("pos"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("ts"),
        (F.sin(F.col("id") / 9.0)).alias("s_0"), F.lit(0.1).alias("s_1"), (-F.sin(F.col("id") / 9.0)).alias("s_2"),
        F.abs(F.cos(F.col("id") / 5.0)).alias("vol_n"), F.lit(2.5).alias("shock"), F.lit(0.05).alias("dd"))
    batch = df.groupBy("symbol").applyInPandas(rg._sequence, rg.SEQUENCE).select("pos", "label").orderBy("pos").collect()
    src = landed(spark, df, str(tmp_path / "in"), lambda d: [d.where("pos < 50"), d.where("pos >= 50 AND pos < 110"), d.where("pos >= 110")])
    got = live.run_available(live.regime_states(src), str(tmp_path / "run")).select("pos", "label").orderBy("pos").collect()
    assert got == batch and len({r.label for r in got}) > 1


def test_stream_daily_rv_equals_closed_batch_days(spark, tmp_path):
    t = spark.range(600).select(F.lit("A").alias("symbol"), (F.timestamp_seconds(F.col("id") * 900 + 1577836800)).alias("ts"),
                                F.col("id").alias("seq"), (F.lit(100.0) + F.sin(F.col("id") * 1.7)).alias("close"))
    r = realised.intraday_returns(t).select("symbol", "ts", "seq", "r")
    want = {x["day"]: x["rv"] for x in realised.realised_variance(realised.intraday_returns(t)).collect()}
    src = landed(spark, r, str(tmp_path / "in"), lambda d: [d.where("seq < 250"), d.where("seq >= 250")])
    got = {x["day"]: x["rv"] for x in live.run_available(live.daily_realised(src), str(tmp_path / "run")).collect()}
    assert len(got) >= 5 and all(abs(v - want[d]) < 1e-12 for d, v in got.items())


def test_stream_changes_ignore_replays(spark, tmp_path):
    rows = [("A", "2020-01-01", 0), ("A", "2020-01-02", 1), ("A", "2020-01-03", 1)]
    df = spark.createDataFrame(rows, "symbol string, d string, label int").select("symbol", F.to_date("d").alias("as_of"), "label")
    src = landed(spark, df, str(tmp_path / "in"), lambda d: [d, d.where("label = 1")])
    assert live.run_available(live.label_changes(src), str(tmp_path / "run")).count() == 1


def test_cache_overwrites_only_given_symbols(spark, bars, tmp_path):
    path = str(tmp_path / "cache")
    sinks.write_cache(bars.select("symbol", "ts", "close"), path)
    sinks.write_cache(bars.where("symbol = 'AA'").select("symbol", "ts", F.lit(1.0).alias("close")), path)
    back = read_closes(spark, path, ["AA", "BB"], "2015-01-01", "2030-01-01")
    assert back.where("symbol = 'AA' AND close = 1.0").count() == 420 and back.where("symbol = 'BB' AND close <> 1.0").count() == 380
