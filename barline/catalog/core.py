"""Sources, projection and alignment, features, realised measures, labels and folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C
from ..functions import frame as fr
from ..functions.scan import rolling_blocks
from ..functions.store import scratch
from ..operators import features as feat
from ..operators import folds, labels, realised
from ..sources import readers as rd
from ..sources import testdata as td
from .base import query
from .sql import W, roll

# ---- sources -----------------------------------------------------------------------------------


@query("scan_close", "", """
SELECT event_type AS symbol, ts, value AS close FROM events WHERE event_type IN ('click', 'purchase')
 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND value IS NOT NULL""",
       keys="symbol ts", floats="close")
def scan_close(spark, sf):
    return rd.scan_close(td.table(spark, sf, "events"), ["click", "purchase"], "2024-01-05", "2024-01-20",
                         symbol="event_type", ts="ts", value="value")


@query("scan_aux_close", "aux", """
SELECT series_id, date, value FROM aux WHERE series_id IN ('vix', 'vix3m')
 AND date >= DATE '1996-01-01' AND date < DATE '2000-01-01'""", keys="series_id date", floats="value")
def scan_aux_close(spark, sf):
    return rd.scan_close(td.aux(spark, sf), ["vix", "vix3m"], "1996-01-01", "2000-01-01",
                         symbol="series_id", ts="date", value="value").select(
        F.col("symbol").alias("series_id"), F.col("ts").alias("date"), F.col("close").alias("value"))


@query("scan_macro_observations", "", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM events
 WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL""", keys="event_id", floats="value")
def scan_macro_observations(spark, sf):
    return rd.parse_observations(td.table(spark, sf, "events"), "props", "$.k").select(
        "event_id", "value")


@query("scan_macro_landed", "", """
SELECT left(o_orderpriority, 1) || o_orderstatus AS series_id, CAST(o_orderdate AS DATE) AS date, CAST(sum(o_totalprice) AS DOUBLE) / count(*) AS value
FROM orders GROUP BY 1, 2 HAVING count(*) % 5 <> 0""", keys="series_id date", floats="value")
def scan_macro_landed(spark, sf):
    """Macro files as they land, one document per series and year with "." for missing values, read back."""
    o = td.table(spark, sf, "orders")
    money = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))
    days = o.groupBy(F.concat(F.left("o_orderpriority", F.lit(1)), "o_orderstatus").alias("series_id"),
                     F.col("o_orderdate").cast("date").alias("date")).agg(
        F.when(F.count(F.lit(1)) % 5 != 0, money.cast("string")).otherwise(".").alias("value"))
    path = scratch(spark) + "/landed"
    docs = days.groupBy("series_id", F.year("date").alias("year")).agg(F.collect_list(F.struct("date", "value")).alias("observations"))
    docs.withColumn("landed", F.concat_ws("-", "series_id", "year")).drop("year").write.partitionBy("landed").json(path)
    return rd.read_observations(spark, path)


@query("scan_ohlcv_last_n", "bars", """
SELECT symbol, ts, open, high, low, close, volume FROM (
 SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars) WHERE rn <= 60""",
       keys="symbol ts", floats="open high low close volume")
def scan_ohlcv_last_n(spark, sf):
    return fr.tail_rows(td.bars(spark, sf), 60, "ts")


@query("scan_close_last_n", "ticks", """
SELECT symbol, ts, close FROM (
 SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS rn FROM ticks) WHERE rn <= 100""",
       keys="symbol ts", floats="close")
def scan_close_last_n(spark, sf):
    return rd.last_ticks(td.ticks(spark, sf), 100)


@query("aux_bundle", "aux_wide", "SELECT * FROM aux_wide", keys="date", floats=" ".join(S.AUX_SERIES))
def aux_bundle(spark, sf):
    return feat.aux_bundle(td.aux(spark, sf))


@query("asset_dim", "", """
SELECT CAST(s_suppkey AS VARCHAR) AS symbol, coalesce(CASE WHEN s_acctbal > 0 THEN s_name END, CAST(s_suppkey AS VARCHAR)) AS name,
 n_name AS market, r_name AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
 LEFT JOIN region ON n_regionkey = r_regionkey""", keys="symbol name market region")
def asset_dim(spark, sf):
    universe = td.table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("symbol"),
        F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("display_name"), "s_nationkey")
    markets = td.table(spark, sf, "nation").join(
        td.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rd.asset_dim(universe, markets, "s_nationkey", "n_nationkey").select(
        "symbol", "name", F.col("n_name").alias("market"), F.col("r_name").alias("region"))


@query("coverage_gate", "sbars", """
SELECT count(*) AS n_expected, count(b.symbol) AS n_ready,
 greatest(1, CAST(floor(count(*) * 0.7) AS BIGINT)) AS n_required,
 count(b.symbol) >= greatest(1, CAST(floor(count(*) * 0.7) AS BIGINT)) AS publish
FROM supplier LEFT JOIN (SELECT symbol FROM sbars GROUP BY 1 HAVING count(*) >= 500) b
 ON CAST(s_suppkey AS VARCHAR) = b.symbol""", keys="publish", ints="n_expected n_ready n_required")
def coverage_gate(spark, sf):
    universe = td.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"))
    ready = td.bars(spark, sf, "supplier").groupBy("symbol").count().where("count >= 500")
    return rd.coverage_gate(universe, ready)


@query("safe_symbol", "", """
SELECT event_id, translate('^' || event_type || '=X/' || CAST(user_id AS VARCHAR), '=^/', '___') AS safe,
 translate('^' || event_type || '=X/' || CAST(user_id AS VARCHAR), '=/', '__') AS cache_safe FROM events""",
       keys="event_id safe cache_safe")
def safe_symbol(spark, sf):
    raw = F.concat(F.lit("^"), "event_type", F.lit("=X/"), F.col("user_id").cast("string"))
    return td.table(spark, sf, "events").select(
        "event_id", C.safe_symbol(raw).alias("safe"), C.safe_symbol(raw, caret=False).alias("cache_safe"))


@query("finite_or_null", "", """
SELECT event_id, CASE WHEN value > 50 THEN value WHEN value > 25 THEN NULL END AS a,
 TRY_CAST(CASE WHEN user_id > 75 THEN props ELSE CAST(user_id AS VARCHAR) END AS DOUBLE) AS b FROM events""",
       keys="event_id", floats="a b")
def finite_or_null(spark, sf):
    v = F.col("value")
    a = F.when(v > 50, v).when(v > 25, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    b = F.when(F.col("user_id") > 75, F.col("props")).otherwise(F.col("user_id").cast("string"))
    return td.table(spark, sf, "events").select(
        "event_id", C.finite_or_null(a).alias("a"), C.finite_or_null(b).alias("b"))


@query("validate_symbol", "", f"""
SELECT c_custkey, c_name, regexp_matches(upper(c_mktsegment), '{S.TICKER_PATTERN}') AS symbol_ok,
 regexp_matches(c_name || CASE WHEN c_acctbal > 0 THEN '@' ELSE ' ' END || lower(c_mktsegment) || '.org', '{S.EMAIL_PATTERN}') AS email_ok
FROM customer""", keys="c_custkey c_name symbol_ok email_ok")
def validate_symbol(spark, sf):
    at = F.when(F.col("c_acctbal") > 0, "@").otherwise(" ")
    email = F.concat("c_name", at, F.lower("c_mktsegment"), F.lit(".org"))
    return td.table(spark, sf, "customer").select(
        "c_custkey", "c_name", rd.valid_symbol(F.upper("c_mktsegment")).alias("symbol_ok"),
        rd.valid_email(email).alias("email_ok"))


@query("history_slice", "bars", """
SELECT symbol, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars)
WHERE rn <= least(greatest(600, 1), 504)""", keys="symbol ts", floats="close")
def history_slice(spark, sf):
    return rd.history_slice(td.bars(spark, sf), days=600)


# ---- projection, filter, alignment ---------------------------------------------------------------

BF = "symbol pos ts"


@query("log_return", "bars_r", "SELECT * FROM bars_r", keys="symbol ts", ints="pos", floats="close r")
def log_return(spark, sf):
    return feat.with_return(td.bars(spark, sf))


@query("log_return_many", "sbars_r", "SELECT * FROM sbars_r", keys="symbol ts", ints="pos", floats="close r")
def log_return_many(spark, sf):
    return feat.with_return(td.bars(spark, sf, "supplier"))


@query("shift_n", "bars", f"""
SELECT symbol, pos, lag(close, 1) OVER {W} AS lag1, lag(close, 5) OVER {W} AS lag5, lead(close, 3) OVER {W} AS lead3
FROM bars""", keys="symbol", ints="pos", floats="lag1 lag5 lead3")
def shift_n(spark, sf):
    w = fr.series()
    return td.bars(spark, sf).select("symbol", "pos", F.lag("close").over(w).alias("lag1"),
                                     F.lag("close", 5).over(w).alias("lag5"),
                                     F.lead("close", 3).over(w).alias("lead3"))


@query("align_ffill", "aligned", "SELECT * FROM aligned", keys="symbol ts", ints="pos",
       floats=" ".join(S.AUX_SERIES))
def align_ffill(spark, sf):
    return fr.align_ffill(td.bars(spark, sf), feat.aux_bundle(td.aux(spark, sf)), S.AUX_SERIES)


@query("complete_cases", "bars_raw", """
SELECT symbol, pos, mom_63, vol_ewma, trend_dir FROM bars_raw WHERE mom_63 IS NOT NULL AND vol_ewma IS NOT NULL
 AND trend_dir IS NOT NULL""", keys="symbol", ints="pos", floats="mom_63 vol_ewma trend_dir")
def complete_cases(spark, sf):
    df = feat.price_features(feat.with_return(td.bars(spark, sf)))
    return fr.complete_cases(df, ["mom_63", "vol_ewma", "trend_dir"])


@query("fill_dead_columns", "aligned", """
SELECT symbol, pos, CASE WHEN count(gld) OVER (PARTITION BY symbol) = 0 THEN 0.0 ELSE gld END AS gld,
 CASE WHEN count(vix) OVER (PARTITION BY symbol) = 0 THEN 0.0 ELSE vix END AS vix, 0.0 AS dead FROM aligned""",
       keys="symbol", ints="pos", floats="gld vix dead")
def fill_dead_columns(spark, sf):
    df = fr.align_ffill(td.bars(spark, sf), feat.aux_bundle(td.aux(spark, sf)), S.AUX_SERIES)
    return fr.fill_dead_columns(df.withColumn("dead", F.lit(None).cast("double")), ["gld", "vix", "dead"])


@query("concat_dedup", "bars", """
SELECT symbol, ts, src, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY src) AS rn FROM (
 SELECT symbol, ts, close, 'train' AS src FROM bars WHERE pos < 1500 UNION ALL
 SELECT symbol, ts, close, 'test' AS src FROM bars WHERE pos >= 1200) u2) WHERE rn = 1 AND src = 'never'
UNION ALL SELECT symbol, ts, CASE WHEN pos < 1500 THEN 'train' ELSE 'test' END AS src, close FROM bars""",
       keys="symbol ts src", floats="close")
def concat_dedup(spark, sf):
    b = td.bars(spark, sf).select("symbol", "pos", "ts", "close")
    train = b.where("pos < 1500").withColumn("src", F.lit("train"))
    test = b.where("pos >= 1200").withColumn("src", F.lit("test"))
    return fr.concat_dedup(train, test, ["symbol", "ts"])


@query("restrict_to_index", "bars aux_wide", """
SELECT symbol, ts, close FROM bars WHERE ts IN (SELECT date FROM aux_wide WHERE vix IS NOT NULL)""",
       keys="symbol ts", floats="close")
def restrict_to_index(spark, sf):
    index = feat.aux_bundle(td.aux(spark, sf)).where("vix IS NOT NULL").select(F.col("date").alias("ts"))
    return fr.restrict_to(td.bars(spark, sf), index, ["ts"])


@query("intersect_index", "bars", """
SELECT a.ts, a.close AS a_close, n.close AS n_close, r.close AS r_close FROM bars a JOIN bars n ON a.ts = n.ts JOIN bars r ON a.ts = r.ts
WHERE a.symbol = 'A' AND n.symbol = 'N' AND r.symbol = 'R'""", keys="ts", floats="a_close n_close r_close")
def intersect_index(spark, sf):
    b = td.bars(spark, sf)
    return fr.intersect_index(
        [b.where(F.col("symbol") == s).select("ts", F.col("close").alias(f"{s.lower()}_close")) for s in "ANR"],
        ["ts"])


@query("reindex_default", "bars aux_wide", """
SELECT b.symbol, b.ts, coalesce(a.vix, 0.5) AS vix FROM bars b LEFT JOIN aux_wide a ON b.ts = a.date""",
       keys="symbol ts", floats="vix")
def reindex_default(spark, sf):
    aux = feat.aux_bundle(td.aux(spark, sf)).select(F.col("date").alias("ts"), "vix")
    return fr.reindex_default(td.bars(spark, sf).select("symbol", "ts"), aux, ["ts"], {"vix": 0.5})


@query("clip", "bars_r", "SELECT symbol, pos, least(greatest(r * 100, -1), 1) AS clipped FROM bars_r WHERE r IS NOT NULL UNION ALL SELECT symbol, pos, NULL FROM bars_r WHERE r IS NULL",
       keys="symbol", ints="pos", floats="clipped")
def clip(spark, sf):
    return feat.with_return(td.bars(spark, sf)).withColumn("clipped", C.clip(F.col("r") * 100, -1.0, 1.0))


@query("label_lookup", "", """
SELECT doc_id, CASE quality WHEN 0 THEN 'Bull' WHEN 1 THEN 'Neutral' END AS regime,
 CASE quality WHEN 0 THEN '#22c55e' WHEN 1 THEN '#a3a3a3' END AS color,
 CASE quality WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 END AS alloc FROM labels""",
       keys="doc_id regime color", floats="alloc")
def label_lookup(spark, sf):
    return td.table(spark, sf, "labels").select(
        "doc_id", C.lookup("quality", S.REGIME_NAMES).alias("regime"),
        C.lookup("quality", S.REGIME_COLORS).alias("color"), C.lookup("quality", S.REGIME_ALLOC).alias("alloc"))


@query("rebase", "bars", """
SELECT symbol, ts, close / first_value(close) OVER (PARTITION BY symbol ORDER BY ts) AS rebased,
 close / first_value(close) OVER (PARTITION BY symbol ORDER BY ts) * 100 AS norm FROM (
 SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars) WHERE rn <= 504""",
       keys="symbol ts", floats="rebased norm")
def rebase(spark, sf):
    tail = fr.tail_rows(td.bars(spark, sf), S.HISTORY_BARS)
    return tail.withColumns({"rebased": fr.rebase("close"), "norm": fr.rebase("close", scale=100.0)})


@query("trailing_return", "bars", """
SELECT symbol, arg_max(close, ts) / arg_min(close, ts) - 1 AS ret_22 FROM (
 SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars) WHERE rn <= 22 GROUP BY symbol""",
       keys="symbol", floats="ret_22")
def trailing_return(spark, sf):
    return rd.trailing_return(td.bars(spark, sf), 22)


@query("every_nth", "bars", "SELECT symbol, pos, close FROM bars WHERE pos % 3 = 0", keys="symbol", ints="pos",
       floats="close")
def every_nth(spark, sf):
    return fr.every_nth(td.bars(spark, sf), 3)


@query("search_universe", "", """
SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower('RinG')) OR contains(lower(p_brand), lower('RinG'))""",
       keys="p_partkey p_name")
def search_universe(spark, sf):
    return rd.search_universe(td.table(spark, sf, "part"), "RinG", ["p_name", "p_brand"])


@query("freshness_class", "", """
SELECT event_id, CASE WHEN age < 6 THEN 'fresh' WHEN age < 24 THEN 'dated' ELSE 'stale' END AS freshness FROM (
 SELECT event_id, (epoch_us(max(ts) OVER ()) - epoch_us(ts)) / 3600000000.0 AS age FROM events)""",
       keys="event_id freshness")
def freshness_class(spark, sf):
    e = td.table(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now"))
    return rd.with_freshness(e, now, "ts").select("event_id", "freshness")


@query("universe_kpis", "sbars_r", """
SELECT count(*) AS n_assets, count(*) FILTER (WHERE coalesce(sharpe, 0) > 0) AS n_positive, avg(coalesce(sharpe, 0)) AS mean_sharpe
FROM (SELECT symbol, CASE WHEN count(r) >= 500 THEN avg(r) / nullif(stddev_samp(r), 0) * sqrt(252) END AS sharpe
 FROM sbars_r GROUP BY symbol)""", ints="n_assets n_positive", floats="mean_sharpe")
def universe_kpis(spark, sf):
    r = feat.with_return(td.bars(spark, sf, "supplier"))
    per = r.groupBy("symbol").agg(F.when(F.count("r") >= 500, C.safe_div(F.avg("r"), F.stddev_samp("r")) * F.sqrt(F.lit(252.0))).alias("sharpe"))
    return rd.universe_kpis(per)


# ---- features ------------------------------------------------------------------------------------


def _raw(spark, sf):
    return feat.price_features(feat.with_return(td.bars(spark, sf)))


query("momentum", "bars_raw", "SELECT * FROM bars_raw", keys="symbol", ints="pos",
      floats="mom_5 mom_20 mom_63 mom_252")(lambda spark, sf: feat.momentum(feat.with_return(td.bars(spark, sf))))
query("ewm_volatility", "bars_raw", "SELECT * FROM bars_raw", keys="symbol", ints="pos",
      floats="vol_short vol_ewma vol_long vol_yearly")(
    lambda spark, sf: feat.ewm_volatility(feat.with_return(td.bars(spark, sf))))
query("vol_ratios", "bars_raw", "SELECT * FROM bars_raw", keys="symbol", ints="pos",
      floats="vol_ratio_sl vol_ratio_ly")(
    lambda spark, sf: feat.ewm_volatility(feat.with_return(td.bars(spark, sf))))
query("shock_z", "bars_raw", "SELECT * FROM bars_raw", keys="symbol", ints="pos", floats="shock_z")(
    lambda spark, sf: feat.ewm_volatility(feat.with_return(td.bars(spark, sf))))
query("drawdown_252", "bars_raw", "SELECT * FROM bars_raw", keys="symbol", ints="pos", floats="drawdown_252")(
    lambda spark, sf: feat.drawdown(td.bars(spark, sf)))
query("autocorr_63", "bars_raw", "SELECT * FROM bars_raw", keys="symbol", ints="pos", floats="autocorr_63")(
    lambda spark, sf: rolling_blocks(feat.with_return(td.bars(spark, sf)).withColumn("_l", F.lag("r").over(fr.series())),
                                     63, corrs={"autocorr_63": ("r", "_l")}))
query("trend_dir", "bars_raw", "SELECT * FROM bars_raw", keys="symbol", ints="pos", floats="trend_dir")(
    lambda spark, sf: feat.trend_direction(td.bars(spark, sf)))


def _cross(spark, sf):
    b = feat.with_return(td.bars(spark, sf).select("symbol", "pos", "ts", "close"))
    df = fr.align_ffill(b, feat.aux_bundle(td.aux(spark, sf)), S.AUX_SERIES)
    return feat.cross_correlation(feat.term_structure(df), {"corr_tlt_63": "tlt", "corr_gld_63": "gld"})


for _name, _cols in {
    "vol_index_logs": "vix_log skew_log vvix_log", "vix_change": "vix_change",
    "vix_term_slope": "vix_term vix_slope", "vix_curvature": "vix_curvature", "vix6m_slope": "vix6m_slope",
    "cross_correlation": "corr_tlt_63 corr_gld_63",
}.items():
    query(_name, "crossed", "SELECT * FROM crossed", keys="symbol", ints="pos", floats=_cols)(_cross)


@query("macro_spreads", "aligned", f"""
SELECT symbol, pos, lag(term_spread) OVER {W} AS term_spread, lag(credit_spread) OVER {W} AS credit_spread FROM aligned""",
       keys="symbol", ints="pos", floats="term_spread credit_spread")
def macro_spreads(spark, sf):
    df = fr.align_ffill(td.bars(spark, sf), feat.aux_bundle(td.aux(spark, sf)), S.AUX_SERIES)
    return feat.lagged(df, ["term_spread", "credit_spread"])


@query("yang_zhang_vol", "yz", "SELECT * FROM yz", keys="symbol", ints="pos", floats="yang_zhang_vol")
def yang_zhang_vol(spark, sf):
    return td.bars(spark, sf).withColumn("yang_zhang_vol", feat.yang_zhang())


@query("features_v1", "bars_f1", "SELECT * FROM bars_f1", keys="symbol ts", ints="pos",
       floats="close r " + " ".join(S.FEATURES_V1))
def features_v1(spark, sf):
    return feat.features_v1(td.bars(spark, sf))


@query("features_v1_many", "sbars_f1", "SELECT * FROM sbars_f1", keys="symbol ts", ints="pos",
       floats="close r " + " ".join(S.FEATURES_V1))
def features_v1_many(spark, sf):
    """The same plan over one series per supplier: the series count grows with the tables."""
    return feat.features_v1(td.bars(spark, sf, "supplier"))


@query("features_v2", "f2", "SELECT * FROM f2", keys="symbol ts", ints="pos",
       floats="close r " + " ".join(S.FEATURES_V2))
def features_v2(spark, sf):
    b = td.bars(spark, sf)
    return feat.features_v2(b, feat.aux_bundle(td.aux(spark, sf)),
                            b.select("symbol", "pos", "ts", "open", "high", "low", "close"))


@query("mixture_inputs", "bars_r", f"""
SELECT symbol, pos, r, lv AS vol FROM (SELECT symbol, pos, r, lag(sqrt(v)) OVER {W} AS lv FROM (
 SELECT t.symbol, t.pos, any_value(t.r) AS r, sum(pow({2 ** (-1 / 20)}, t.pos - i.pos) *
   CASE WHEN i.pos = 1 THEN i.r*i.r ELSE {1 - 2 ** (-1 / 20)} * i.r*i.r END) AS v
 FROM bars_r t JOIN bars_r i ON t.symbol = i.symbol AND i.pos <= t.pos AND i.r IS NOT NULL GROUP BY t.symbol, t.pos))
WHERE lv IS NOT NULL AND r IS NOT NULL""", keys="symbol", ints="pos", floats="r vol")
def mixture_inputs(spark, sf):
    return feat.mixture_inputs(td.bars(spark, sf)).withColumn("pos", F.col("pos") + 2)


@query("rolling_minmax_norm", "bars", f"""
SELECT symbol, pos, CASE WHEN hi > lo THEN least(greatest((close - lo) / (hi - lo), 0), 1) ELSE 0.5 END AS normed FROM (
 SELECT symbol, pos, close, {roll('min', 'close', 252, 20)} AS lo, {roll('max', 'close', 252, 20)} AS hi FROM bars)""",
       keys="symbol", ints="pos", floats="normed")
def rolling_minmax_norm(spark, sf):
    return feat.minmax_normalise(td.bars(spark, sf), {"normed": "close"})


@query("rolling_vol", "bars_r", f"""
SELECT symbol, pos, coalesce(first_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
 last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS vol_fallback,
 lag(f) OVER {W} AS vol_rolling
FROM (SELECT symbol, pos, {roll('stddev_samp', 'r', 21, 5)} AS v, {roll('stddev_samp', 'r', 21)} AS f FROM bars_r)""",
       keys="symbol", ints="pos", floats="vol_fallback vol_rolling")
def rolling_vol(spark, sf):
    return feat.rolling_vol(feat.with_return(td.bars(spark, sf)))


@query("lookback_sequences", "bars_raw", """
SELECT a.symbol, a.pos AS end_pos, count(*) AS bars_in, sum(b.mom_5) AS sum_first, sum(b.trend_dir * (b.pos - a.pos + 30)) AS weighted
FROM bars_raw a JOIN bars_raw b ON a.symbol = b.symbol AND b.pos BETWEEN a.pos - 29 AND a.pos
WHERE a.pos >= 62 + 29 GROUP BY 1, 2""", keys="symbol", ints="end_pos bars_in", floats="sum_first weighted")
def lookback_sequences(spark, sf):
    """Thirty-bar tensors; the check folds each tensor with a position weight."""
    df = _raw(spark, sf).where("pos >= 62").select("symbol", "pos", "ts", "mom_5", "trend_dir")
    seq = feat.lookback_sequences(df, ["mom_5", "trend_dir"], 30)
    fold = F.aggregate("sequence", F.lit(0.0), lambda acc, v: acc + v[0])
    weighted = F.aggregate(F.transform("sequence", lambda v, i: v[1] * (i + 1)), F.lit(0.0), lambda acc, v: acc + v)
    return seq.select("symbol", "end_pos", F.size("sequence").alias("bars_in"), fold.alias("sum_first"),
                      weighted.alias("weighted"))


# ---- realised measures ---------------------------------------------------------------------------


def _ticks_r(spark, sf):
    return realised.intraday_returns(td.ticks(spark, sf))


query("intraday_returns", "tick_r", "SELECT * FROM tick_r", keys="symbol ts", ints="seq", floats="r")(_ticks_r)


@query("realised_variance", "tick_day tick_cal", """
SELECT c.symbol, c.day, coalesce(d.rv, 0) AS rv FROM tick_cal c LEFT JOIN tick_day d USING (symbol, day)""",
       keys="symbol day", floats="rv")
def realised_variance(spark, sf):
    return realised.realised_variance(_ticks_r(spark, sf))


@query("realised_semivariance", "tick_day tick_cal", """
SELECT c.symbol, c.day, coalesce(d.rsv_pos, 0) AS rsv_pos, coalesce(d.rsv_neg, 0) AS rsv_neg
FROM tick_cal c LEFT JOIN tick_day d USING (symbol, day)""", keys="symbol day", floats="rsv_pos rsv_neg")
def realised_semivariance(spark, sf):
    return realised.realised_semivariance(_ticks_r(spark, sf))


@query("realised_skewness", "tick_day tick_cal", """
SELECT c.symbol, c.day, coalesce(sqrt(d.n) * d.r3 / nullif(pow(d.rv, 1.5), 0), 0) AS rskew
FROM tick_cal c LEFT JOIN tick_day d USING (symbol, day)""", keys="symbol day", floats="rskew")
def realised_skewness(spark, sf):
    return realised.realised_skewness(_ticks_r(spark, sf))


@query("bipower_variation", "tick_bv tick_cal", """
SELECT c.symbol, c.day, coalesce(d.bv, 0) AS bv FROM tick_cal c LEFT JOIN tick_bv d USING (symbol, day)""",
       keys="symbol day", floats="bv")
def bipower_variation(spark, sf):
    return realised.bipower_variation(_ticks_r(spark, sf))


@query("jump_component", "tick_day tick_bv tick_cal", """
SELECT c.symbol, c.day, coalesce(d.rv, 0) AS rv, coalesce(b.bv, 0) AS bv, greatest(coalesce(d.rv, 0) - coalesce(b.bv, 0), 0) AS jump
FROM tick_cal c LEFT JOIN tick_day d USING (symbol, day) LEFT JOIN tick_bv b USING (symbol, day)""",
       keys="symbol day", floats="rv bv jump")
def jump_component(spark, sf):
    return realised.jump_component(_ticks_r(spark, sf))


@query("ohlc_bars", "ticks", """
SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(close, (ts, seq)) AS open, max(close) AS high, min(close) AS low,
 arg_max(close, (ts, seq)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2""",
       keys="symbol ts", floats="open high low close volume")
def ohlc_bars(spark, sf):
    return realised.ohlc_bars(td.ticks(spark, sf), "1 hour")


# ---- labels --------------------------------------------------------------------------------------


def tb(spark, sf, by="flag"):
    return labels.label_horizon(labels.triple_barrier(feat.features_v1(td.bars(spark, sf, by))))


query("triple_barrier", "tb", "SELECT * FROM tb", keys="symbol ts", ints="pos t1 label", floats="ret")(tb)
query("label_horizon", "tb", "SELECT * FROM tb", keys="symbol", ints="pos horizon")(tb)


@query("label_balance", "tb", """
SELECT symbol, label, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY symbol) AS fraction FROM tb GROUP BY 1, 2""",
       keys="symbol", ints="label n", floats="fraction")
def label_balance(spark, sf):
    return labels.label_balance(tb(spark, sf))


query("label_concurrency", "conc", "SELECT * FROM conc", keys="symbol", ints="pos concurrency")(
    lambda spark, sf: labels.label_concurrency(tb(spark, sf)))
query("label_uniqueness", "uniq", "SELECT * FROM uniq", keys="symbol", ints="pos", floats="uniqueness")(
    lambda spark, sf: labels.label_uniqueness(tb(spark, sf)))


@query("sample_weights", "tb uniq", """
SELECT symbol, pos, w / avg(w) OVER (PARTITION BY symbol) AS weight FROM (
 SELECT t.symbol, t.pos, u.uniqueness * abs(t.ret) / avg(abs(t.ret)) OVER (PARTITION BY t.symbol)
  * exp(-1.0 * (count(*) OVER (PARTITION BY t.symbol) - 1 - t.pos) / (count(*) OVER (PARTITION BY t.symbol) - 1)) AS w
 FROM tb t JOIN uniq u ON t.symbol = u.symbol AND t.pos = u.pos)""", keys="symbol", ints="pos", floats="weight")
def sample_weights(spark, sf):
    return labels.sample_weights(tb(spark, sf))


@query("transition_target", "tb", """
SELECT symbol, pos, CASE WHEN n = 5 AND (lo <> label OR hi <> label) THEN 1 ELSE 0 END AS target, n = 5 AS in_fit FROM (
 SELECT symbol, pos, label, count(label) OVER w AS n, min(label) OVER w AS lo, max(label) OVER w AS hi FROM tb
 WINDOW w AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))""",
       keys="symbol in_fit", ints="pos target")
def transition_target(spark, sf):
    return labels.transition_target(tb(spark, sf))
