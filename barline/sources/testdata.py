"""Driver tables as series: which raw column plays symbol, time and value.

Raw rows are reduced to one row per series and day before any window runs. The reduction is a
partial aggregate on the map side, so a symbol holding a third of all raw rows shuffles no more
than one row per task and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frame import with_pos

SMOOTH = 20
SERIES_KEY = {"flag": "l_returnflag", "supplier": "l_suppkey"}
AUX_BY_PRIORITY = {"1-URGENT": "vix", "2-HIGH": "vix3m", "3-MEDIUM": "vix9d",
                   "4-NOT SPECIFIED": "tlt", "5-LOW": "term_spread"}
AUX_BY_STATUS = {"F": "vix6m", "O": "skew", "P": "vvix"}
AUX_BY_CUSTOMER = {"0": "gld", "1": "credit_spread"}
"""Last digit of the customer key; the other digits map to no series."""
CUSTOMER_DIGIT = "right(CAST(o_custkey AS STRING), 1)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, by: str = "flag") -> DataFrame:
    """Daily OHLCV per series from lineitem; close is a 20-day volume-weighted average price."""
    money = "decimal(18,2)"
    day = (table(spark, sf_dir, "lineitem")
           .groupBy(F.col(SERIES_KEY[by]).cast("string").alias("symbol"),
                    F.col("l_shipdate").cast("date").alias("ts"))
           .agg(F.sum(F.col("l_extendedprice").cast(money)).alias("amt"),
                F.sum(F.col("l_quantity").cast(money)).alias("qty")))
    w = Window.partitionBy("symbol").orderBy("ts")
    smooth = w.rowsBetween(-(SMOOTH - 1), 0)
    price = F.col("amt").cast("double") / F.col("qty").cast("double")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)

    def recent(c: str) -> Column:
        """The sum over ``smooth`` as a difference of running sums: decimals are exact, and no frame is summed."""
        run, n = F.col(f"_{c}"), F.col(f"_n_{c}")
        some = n > F.lag(n, SMOOTH, 0).over(w)
        return F.when(some, run - F.coalesce(F.lag(run, SMOOTH).over(w), F.lit(0).cast("decimal(38,2)"))).cast("double")

    run = {f"_{c}": F.sum(c).over(upto).cast("decimal(38,2)") for c in ("amt", "qty")}
    run |= {f"_n_{c}": F.count(c).over(upto) for c in ("amt", "qty")}
    out = with_pos(day).withColumns(run).withColumns({
        "close": recent("amt") / recent("qty"), "_hi": F.max(price).over(smooth), "_lo": F.min(price).over(smooth)})
    out = out.withColumn("open", F.coalesce(F.lag("close").over(w), F.col("close")))
    return out.select(
        "symbol", "pos", "ts", "open", F.greatest("_hi", "open").alias("high"),
        F.least("_lo", "open").alias("low"), "close", F.col("qty").cast("double").alias("volume"))


def aux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Auxiliary daily series from orders: five by priority, three by status, two by customer."""
    o = table(spark, sf_dir, "orders")

    def level(key: str, names: dict[str, str]) -> DataFrame:
        series_id = F.coalesce(*[F.when(F.expr(key) == k, F.lit(v)) for k, v in names.items()])
        return (o.groupBy(series_id.alias("series_id"), F.col("o_orderdate").cast("date").alias("date"))
                .agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
                      / F.count(F.lit(1))).alias("value"))
                .where("series_id IS NOT NULL"))

    return level("o_orderpriority", AUX_BY_PRIORITY).unionByName(
        level("o_orderstatus", AUX_BY_STATUS)).unionByName(level(CUSTOMER_DIGIT, AUX_BY_CUSTOMER))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as intraday prices, one series per event type; non-positive is no price."""
    return (table(spark, sf_dir, "events").where("value > 0")
            .select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
                    F.col("event_id").alias("seq"), F.col("value").alias("close")))


def recession_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly 0/1 flag: share of finished orders in the month above one third."""
    return (table(spark, sf_dir, "orders")
            .groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"))
            .agg((F.count_if(F.col("o_orderstatus") == "F") * 3 > F.count(F.lit(1))).cast("int")
                 .alias("flag")))
