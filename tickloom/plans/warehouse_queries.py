"""Queries of the warehouse operators and of the streams, on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.plans.bars import BARS_SQL, bars_eod, table
from tickloom.plans.series_queries import tidy
from tickloom.plans.sqltext import r, rounded
from tickloom.sources import barfiles, barsource, merge
from tickloom.sources.folders import work_folder
from tickloom.sources.parts import PartTable
from tickloom.streaming import live

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(make):
        QUERIES[name] = make
        if sql:
            SQL[name] = sql
        return make

    return register


@query("m_upsert", f"WITH {BARS_SQL} SELECT ticker, ts, CASE WHEN ts >= DATE '2001-01-01' THEN {r('close * 2')} ELSE {r('close')} END AS close, volume FROM bars UNION ALL SELECT 'NEW', ts, {r('close')}, volume FROM bars WHERE ticker = 'S1' AND ts >= DATE '2001-01-01'")
def _(spark, d):
    """Bars, merged with corrected bars of the last year and a new ticker."""
    bars = bars_eod(spark, d).select("ticker", "ts", "close", "volume")
    late = bars.where("ts >= date '2001-01-01'")
    updates = late.withColumn("close", F.col("close") * 2).unionByName(late.where("ticker = 'S1'").withColumn("ticker", F.lit("NEW"))).withColumn("extra", F.lit(1))
    return tidy(merge.merged(bars, updates, ["ticker", "ts"]))


@query("m_upsert_buckets", SQL["m_upsert"])
def _(spark, d):
    """The same merge written: a bucketed table, the corrected year merged into the buckets it touches, and the table read again."""
    bars = bars_eod(spark, d).select("ticker", "ts", "close", "volume")
    late = bars.where("ts >= date '2001-01-01'")
    stored = PartTable(spark, f"{work_folder(spark)}/bars")
    stored.create(bars, ["ticker", "ts"], ["ticker"])
    stored.upsert(late.withColumn("close", F.col("close") * 2).unionByName(late.where("ticker = 'S1'").withColumn("ticker", F.lit("NEW"))))
    return tidy(stored.read())


_YEAR_END = "ts >= DATE '2000-06-01'"


@query("m_replace_keys", f"WITH {BARS_SQL}, n AS (SELECT ticker, ts, close / 2 AS close, volume FROM bars WHERE ticker LIKE 'S1%' AND {_YEAR_END}) SELECT ticker, ts, {r('close')} AS close, volume FROM (SELECT ticker, ts, close, volume FROM bars WHERE ticker NOT IN (SELECT ticker FROM n) UNION ALL SELECT * FROM n)")
def _(spark, d):
    """All bars of some tickers deleted and newer, corrected ones inserted, as one change."""
    bars = bars_eod(spark, d).select("ticker", "ts", "close", "volume")
    stored = PartTable(spark, f"{work_folder(spark)}/bars")
    stored.create(bars, ["ticker", "ts"], ["ticker"])
    stored.replace_keys(bars.where(f"ticker LIKE 'S1%' AND {_YEAR_END}").withColumn("close", F.col("close") / 2))
    return tidy(stored.read())


@query("m_reload_days", f"WITH {BARS_SQL}, l AS (SELECT max(ts) AS last FROM bars) SELECT ticker, ts, CASE WHEN ts >= last - 90 THEN {r('close * 3')} ELSE {r('close')} END AS close, volume FROM bars, l WHERE ts < last - 90 OR volume > 20")
def _(spark, d):
    """The last 90 days loaded anew from a source that has other rows; older days stay."""
    bars = bars_eod(spark, d).select("ticker", "ts", "close", "volume")
    stored = PartTable(spark, f"{work_folder(spark)}/bars")
    stored.create(bars, ["ticker", "ts"], ["ticker"])
    last = stored.read().agg(F.max("ts")).first()[0]
    source = bars.where("volume > 20").withColumn("close", F.col("close") * 3)
    stored.reload(source, merge.last_days("ts", 90, last))
    return tidy(stored.read())


@query("m_keep_last", "SELECT user_id, ts::DATE AS ts, arg_max(event_id, row(ts, event_id)) AS event_id FROM events GROUP BY ALL")
def _(spark, d):
    """Of a user's events on a day the last: intraday rows collapsed to one a day."""
    events = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id")
    return merge.keep_last(events, ["user_id", "day"], ["ts", "event_id"]).select("user_id", F.col("day").alias("ts"), "event_id")


@query("m_calendar", "WITH t AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS ts FROM orders), e AS (SELECT min(ts) AS a, max(ts) AS b FROM t), c AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS ts FROM e) SELECT c.ts, dayname(c.ts) AS day_name, CASE WHEN dayname(c.ts) NOT IN ('Saturday', 'Sunday') AND t.ts IS NULL THEN 'Y' ELSE 'N' END AS is_holiday FROM c LEFT JOIN t USING (ts)")
def _(spark, d):
    trading = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("ts"))
    a, b = trading.agg(F.min("ts"), F.max("ts")).first()
    days = merge.with_holidays(merge.calendar(spark, a, b), trading)
    return days.select(F.col("FullDate").alias("ts"), F.col("DayNameOfWeek").alias("day_name"), F.col("isHoliday").alias("is_holiday"))


_STATEMENT = "SELECT 'C' || o_custkey AS ticker, 'Q' || quarter(o_orderdate) || '/' || year(o_orderdate) AS quarter, CAST(sum(o_totalprice) AS DECIMAL(38,2)) AS total FROM orders WHERE {0} GROUP BY ALL"


@query("j_quarterly_mart", "WITH i AS (" + _STATEMENT.format("o_orderstatus = 'F'") + "), b AS (" + _STATEMENT.format("o_orderstatus = 'O'") + "), p AS (" + _STATEMENT.format("o_orderstatus = 'P'") + "), j AS (SELECT coalesce(i.ticker, b.ticker) AS ticker, coalesce(i.quarter, b.quarter) AS quarter, i.total AS income, b.total AS balance FROM i FULL JOIN b USING (ticker, quarter)) SELECT coalesce(j.ticker, p.ticker) AS ticker, coalesce(j.quarter, p.quarter) AS quarter, round(CAST(income AS DOUBLE), 1) AS income, round(CAST(balance AS DOUBLE), 1) AS balance, round(CAST(p.total AS DOUBLE), 1) AS ratio, make_date(CAST(right(coalesce(j.quarter, p.quarter), 4) AS INT), 3 * CAST(substr(coalesce(j.quarter, p.quarter), 2, 1) AS INT) - 2, 1) AS quarter_start FROM j FULL JOIN p USING (ticker, quarter)".replace("sum(o_totalprice)", "sum(CAST(o_totalprice AS DECIMAL(18,2)))"))
def _(spark, d):
    """Three quarterly statements, here the order totals of each status, joined into one mart."""
    orders = table(spark, d, "orders").select("o_orderstatus", F.concat(F.lit("C"), "o_custkey").alias("ticker"), F.concat(F.lit("Q"), F.quarter("o_orderdate"), F.lit("/"), F.year("o_orderdate")).alias("quarter"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"))
    one = lambda s: orders.where(F.col("o_orderstatus") == s).groupBy("ticker", "quarter").agg(F.sum("total").alias("total"))
    mart = merge.quarterly_mart(one("F"), one("O"), one("P"))
    return mart.select("ticker", "quarter", *[F.round(F.col(c).cast("double"), 1).alias(n) for c, n in (("total", "income"), ("total (balance)", "balance"), ("total (ratios)", "ratio"))], "quarter_start")


@query("m_aligned", "SELECT s_suppkey, CAST(floor(s_acctbal) AS BIGINT) AS balance, CAST(NULL AS DATE) AS since, TRY_CAST(substr(s_name, 10) AS INT) AS number FROM supplier")
def _(spark, d):
    like = spark.createDataFrame([], "s_suppkey long, balance long, since date, number int")
    rows = table(spark, d, "supplier").select("s_suppkey", F.floor("s_acctbal").alias("balance"), F.expr("substr(s_name, 10)").alias("number"), "s_nationkey")
    return merge.aligned(rows, like)


_CENTS = ", ".join(f"{r(f'round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 2)')} AS {c}" for c in ("open", "high", "low", "close"))


@query("s_bar_files", f"WITH {BARS_SQL} SELECT 'stock' AS asset_class, ticker, ts, {_CENTS}, volume FROM bars")
def _(spark, d):
    """Daily bars written as 32-byte records, a file for each ticker, and read again by ranges of records."""
    folder = work_folder(spark)
    barsource.write_bars(bars_eod(spark, d), folder)
    return tidy(barsource.read_bars(spark, folder, split_bytes=1 << 16).drop("open_int"))


@query("s_screen_files", f"WITH {BARS_SQL}, x AS (SELECT ticker, max(ts) AS last, sum(volume) AS volume, {r('max(high)')} AS top FROM bars GROUP BY ticker) SELECT x.ticker AS Ticker, replace(s_comment, ',', '') AS note, CAST(last AS VARCHAR) AS last, volume, top FROM x JOIN (SELECT 'S' || s_suppkey AS ticker, 'Room ' || s_suppkey || ', Hall ' || s_nationkey AS s_comment FROM supplier) s ON s.ticker = x.ticker")
def _(spark, d):
    """A screen written as CSV without commas in its texts, and read from the first of two paths that exists; its first column becomes the key."""
    names = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"), F.concat(F.lit("Room "), "s_suppkey", F.lit(", Hall "), "s_nationkey").alias("note"))
    last = bars_eod(spark, d).groupBy("ticker").agg(F.max("ts").cast("string").alias("last"), F.sum("volume").alias("volume"), rounded(F.max("high")).alias("top"))
    folder = work_folder(spark)
    barfiles.write_screen(names.join(last, names["symbol"] == last["ticker"]).drop("ticker"), f"{folder}/screen")
    found = barfiles.read_table_file(spark, [f"{folder}/none.parquet", f"{folder}/screen"])
    return found.select("Ticker", "note", F.col("last").cast("string").alias("last"), F.col("volume").cast("long").alias("volume"), "top")


@query("m_clean_texts", "SELECT upper(trim(c_name)) AS key, nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_mktsegment END), '') AS segment, c_acctbal AS balance, CASE WHEN c_custkey % 5 > 0 THEN c_custkey * 1000 END AS number FROM customer WHERE c_custkey % 7 > 0")
def _(spark, d):
    """Keys trimmed and in upper case, rows without one dropped, control characters and blanks taken out, numbers read from texts with thousands separators."""
    id_ = F.col("c_custkey")
    dirty = table(spark, d, "customer").select(
        F.when(id_ % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" \t"), F.lower("c_name"), F.lit("\u0007 "))).alias("key"),
        F.when(id_ % 3 == 0, "  ").otherwise(F.concat(F.col("c_mktsegment"), F.lit("\u0001"))).alias("segment"),
        F.col("c_acctbal").alias("balance"),
        F.when(id_ % 5 == 0, "n/a").otherwise(F.format_number(id_ * 1000, 0)).alias("number"),
    )
    clean = merge.blank_to_null(merge.normalise_key(merge.scrub(dirty), "key"))
    return clean.select("key", "segment", "balance", merge.number("number").cast("long").alias("number"))


_TICKS = "SELECT event_type AS ticker, time_bucket(INTERVAL '15 minutes', ts) AS bar, ts, event_id, value AS price FROM events"


@query("y_live_bars", f"SELECT ticker, bar AS ts, {r('arg_min(price, row(ts, event_id, price))')} AS open, {r('max(price)')} AS high, {r('min(price)')} AS low, {r('arg_max(price, row(ts, event_id, price))')} AS close, count(*) AS volume FROM ({_TICKS}) GROUP BY ALL")
def _(spark, d):
    """Bars built by a stream over the events, merged batch by batch into a table."""
    events = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    ticks = events.select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1).cast("long").alias("volume"))
    bars = live.live_bars(ticks, late="40 days")
    folder = work_folder(spark)
    live.upsert_stream(bars, f"{folder}/bars", ["ticker", "ts"], ["volume"], f"{folder}/state").awaitTermination()
    return tidy(PartTable(spark, f"{folder}/bars").read().withColumn("ts", F.col("ts").cast("timestamp_ntz")))
