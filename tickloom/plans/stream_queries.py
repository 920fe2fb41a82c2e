"""Queries of the streams that carry state, on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.plans import walks
from tickloom.plans.bars import INTRADAY_SQL, bars_intraday, table
from tickloom.plans.series_queries import tidy
from tickloom.plans.sqltext import SPEC, W, over, r
from tickloom.sources.folders import work_folder
from tickloom.sources.parts import PartTable
from tickloom.streaming import averages, live

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(make):
        QUERIES[name] = make
        if sql:
            SQL[name] = sql
        return make

    return register


_BARS = (
    INTRADAY_SQL.format(width="1 hour").replace("ticks AS", "events_of AS").replace("FROM ticks", "FROM events_of")
    + f", b AS MATERIALIZED (SELECT ticker, ts, close, row_number() {W} AS i, lag(close) {W} AS c1 FROM intraday)"
    + f""", c AS MATERIALIZED (SELECT *, CASE WHEN i = 15 THEN avg(greatest(close - c1, 0)) {over(14)} WHEN i > 15 THEN greatest(close - c1, 0) END AS gain,
 CASE WHEN i = 15 THEN avg(greatest(c1 - close, 0)) {over(14)} WHEN i > 15 THEN greatest(c1 - close, 0) END AS loss FROM b)"""
)
_AVERAGES = walks.walk({"e14": walks.ema("close", 14)} | walks.RSI, ctes=_BARS, source="c")


def stream_of(spark, batches: list[DataFrame], make, folder: str, keys: tuple[str, ...] = ("ticker", "ts"), order: str = "close") -> DataFrame:
    """The table that a stream over ``batches`` fills, one run of the stream for each."""
    schema = batches[0].schema
    for batch in batches:
        batch.write.mode("append").parquet(f"{folder}/in")
        stream = make(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        live.upsert_stream(stream, f"{folder}/out", list(keys), [order], f"{folder}/state", by=["ticker"]).awaitTermination()
    return PartTable(spark, f"{folder}/out").read()


def wrong_then_right(bars: DataFrame) -> list[DataFrame]:
    """Bars of which some come wrong and others not at all at first, and then those."""
    kind = F.pmod(F.xxhash64("ticker", "ts"), F.lit(12))
    first = bars.where(kind != 0).withColumn("close", F.when(kind == 1, F.col("close") * 2).otherwise(F.col("close")))
    return [first, bars.where(kind <= 1)]


def ticks_of(spark, d) -> DataFrame:
    events = table(spark, d, "events")
    return events.select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), (F.col("event_id") % 9 + 1).cast("long").alias("volume"))


@query("y_incremental_averages", f"WITH RECURSIVE {_AVERAGES} SELECT ticker, ts, {r('close')} AS close, {r('e14')} AS ema, {r('rsi')} AS rsi FROM w")
def _(spark, d):
    """EMA and RSI by a stream that first gets some bars wrong and others not at all, then the right ones."""
    bars = bars_intraday(spark, d).select("ticker", F.col("ts").cast("timestamp").alias("ts"), "close")
    averages.use_rocks(spark)
    made = stream_of(spark, wrong_then_right(bars), lambda b: averages.incremental_averages(b, 14).where("not too_late").drop("too_late"), work_folder(spark))
    return tidy(made.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query("y_alerts", f"WITH RECURSIVE {_AVERAGES} SELECT ticker, ts, {r('close')} AS close, {r('rsi')} AS rsi, CASE WHEN rsi < 40 THEN 'oversold' ELSE 'overbought' END AS alert FROM w WHERE rsi < 40 OR rsi > 60")
def _(spark, d):
    """Alerts on the RSI of a stream of right bars, added to a table as they come."""
    bars = bars_intraday(spark, d).select("ticker", F.col("ts").cast("timestamp").alias("ts"), "close")
    middle = bars.agg(F.timestamp_micros(F.avg(F.unix_micros("ts")).cast("long"))).first()[0]
    averages.use_rocks(spark)
    parts = [bars.where(F.col("ts") < middle), bars.where(F.col("ts") >= middle)]
    made = stream_of(spark, parts, lambda b: live.alerts(averages.incremental_averages(b, 14), 40, 60).select("ticker", "ts", "close", "rsi", "alert"), work_folder(spark))
    return tidy(made.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


_DAY = "greatest(0, least(hour(last_ts) * 60 + minute(last_ts), 690) - 540) + greatest(0, least(hour(last_ts) * 60 + minute(last_ts), 900) - 780)"


@query("y_session_vwap", f"WITH s AS (SELECT event_type AS ticker, date_trunc('day', ts) AS session, sum(value * (event_id % 9 + 1)) / sum(event_id % 9 + 1) AS vwap, CAST(sum(event_id % 9 + 1) AS BIGINT) AS volume, max(ts) AS last_ts FROM events GROUP BY ALL) SELECT ticker, CAST(session AS TIMESTAMP) AS session, {r('vwap')} AS vwap, volume, last_ts, {r(f'volume * 270 / nullif({_DAY}, 0)')} AS expected FROM s")
def _(spark, d):
    """Running volume-weighted price and expected volume of each day, from ticks of which a third comes late."""
    ticks = ticks_of(spark, d)
    late = F.col("seq") % 3 == 0
    made = stream_of(spark, [ticks.where(~late), ticks.where(late)], lambda t: live.live_vwap(t, "60 days"), work_folder(spark), ("ticker", "session"), "volume")
    return tidy(made.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session", "last_ts")}))


@query("y_late_ticks", f"SELECT ticker, ts, {', '.join(f'{r(c)} AS {c}' for c in ('open', 'high', 'low', 'close'))}, CAST(volume AS BIGINT) AS volume FROM (SELECT event_type AS ticker, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(value, row(ts, event_id, value)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id, value)) AS close, sum(event_id % 9 + 1) AS volume FROM events GROUP BY event_type, time_bucket(INTERVAL '1 hour', ts))")
def _(spark, d):
    """Hourly bars of a stream whose ticks come in three runs out of order; a bar that changes replaces the one stored."""
    ticks = ticks_of(spark, d)
    parts = [ticks.where(F.col("seq") % 3 == k) for k in (1, 0, 2)]
    made = stream_of(spark, parts, lambda t: live.live_bars(t, "1 hour", "60 days"), work_folder(spark), order="volume")
    return tidy(made.withColumn("ts", F.col("ts").cast("timestamp_ntz")))
