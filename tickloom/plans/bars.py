"""Bars, index, dimension, flows and calendar, derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_ticks(ticks: DataFrame, ts, price: str, volume, order: list[str]) -> DataFrame:
    """OHLCV bars of (ticker, ts): open and close by the order columns, partial sums before the shuffle."""
    key = F.struct(*order, price)
    return ticks.groupBy("ticker", ts.alias("ts")).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), volume.cast("long").alias("volume")
    )


def bars_eod(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: a supplier is a ticker, a line item a tick at its unit price."""
    ticks = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"), "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("d"), "l_quantity", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price")
    )
    return from_ticks(ticks, F.col("d"), "price", F.sum("l_quantity"), ["l_orderkey", "l_linenumber"])


def bars_intraday(spark: SparkSession, sf_dir: str, width: str = "1 hour") -> DataFrame:
    """Intraday bars: an event type is a ticker, an event a tick."""
    ticks = table(spark, sf_dir, "events").select(F.col("event_type").alias("ticker"), "ts", "event_id", F.col("value").alias("price"))
    return from_ticks(ticks, F.window("ts", width)["start"], "price", F.count("*"), ["ts", "event_id"])


def smooth_bars(spark: SparkSession, sf_dir: str, n: int = 60) -> DataFrame:
    """Daily bars whose prices are means of the last ``n`` bars, so that they move as little from day to day as those of a market; volume is as traded."""
    w = Window.partitionBy("ticker").orderBy("ts")
    mean = {c: F.avg(c).over(w.rowsBetween(-(n - 1), 0)).alias(c) for c in ("open", "high", "low", "close")}
    return bars_eod(spark, sf_dir).select("ticker", "ts", *mean.values(), "volume", F.row_number().over(w).alias("_nth")).where(F.col("_nth") >= n).drop("_nth")


def index_series(bars: DataFrame) -> DataFrame:
    """Volume-weighted mean close of each date."""
    return bars.groupBy("ts").agg((F.sum(F.col("close") * F.col("volume")) / F.sum("volume")).alias("index_close"), F.sum("volume").alias("index_volume"))


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticker dimension: name, industry (nation), market (region)."""
    nation = F.broadcast(table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")))  # 25 and 5 rows in any size
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker"), F.col("s_name").alias("full_name"), F.col("n_name").alias("industry"), F.col("r_name").alias("market"), F.col("s_acctbal").alias("balance")
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bought and sold quantity and value of each ticker and date."""
    buy, sell = F.col("l_returnflag") == "N", F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"), F.to_date("l_shipdate").alias("ts")).agg(
        *[F.coalesce(F.sum(F.when(side, F.col(c))), F.lit(0.0)).alias(n) for side, c, n in ((buy, "l_quantity", "buy_qty"), (sell, "l_quantity", "sell_qty"), (buy, "l_extendedprice", "buy_value"), (sell, "l_extendedprice", "sell_value"))]
    )


#: DuckDB views of the same, for the SQL of the queries.
BARS_SQL = """bars AS (
  SELECT ticker, ts, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM (SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS ts, l_extendedprice / l_quantity AS price, l_quantity,
               row(l_orderkey, l_linenumber, l_extendedprice / l_quantity) AS k FROM lineitem)
  GROUP BY ticker, ts)"""
INTRADAY_SQL = """ticks AS (
  SELECT event_type AS ticker, time_bucket(INTERVAL '{width}', ts) AS bar, ts, event_id, value AS price FROM events),
intraday AS (
  SELECT ticker, bar AS ts, arg_min(price, row(ts, event_id, price)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(ts, event_id, price)) AS close, count(*) AS volume
  FROM ticks GROUP BY ticker, bar)"""
#: The same of ``smooth_bars``; the smooth table is named bars, so SQL over bars serves both.
SMOOTH_SQL = (
    BARS_SQL.replace("bars AS", "rough AS", 1)
    + """, bars AS (
  SELECT ticker, ts, """
    + ", ".join(f"avg({c}) OVER m AS {c}" for c in ("open", "high", "low", "close"))
    + """, volume FROM rough WINDOW m AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts) >= 60)"""
)
