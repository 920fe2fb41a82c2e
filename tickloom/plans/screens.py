"""Screeners and exports: compositions of the operators with fixed output columns."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import recur as k
from tickloom.functions.frame import Frame
from tickloom.operators import candles, crosssection, indicators as ind, patterns, timeframes, vpa
from tickloom.operators.scan import scan
from tickloom.plans import vpa_sql
from tickloom.plans.bars import BARS_SQL, INTRADAY_SQL, bars_eod, bars_intraday, dimension, flows, index_series
from tickloom.plans.series_queries import framed, out, tidy
from tickloom.plans.sqltext import KEYS, SO_FAR, SPEC, W, div, full, hhv, lag, llv, ma, over, r, staged, total

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(make):
        QUERIES[name] = make
        if sql:
            SQL[name] = sql
        return make

    return register


def last_bars(f: Frame, n: int = 1) -> DataFrame:
    """The last n bars of each ticker."""
    nth = F.row_number().over(Window.partitionBy(f.by).orderBy(F.desc(f.order)))
    return f.df.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")


def liquid(f: Frame, least: float, bars: int = 5):
    """Volume of at least ``least`` on this bar and those before it."""
    return F.coalesce(f.llv("volume", bars) >= least, F.lit(False))


LEAST_VOLUME = 5
_MA = {"ma20": ma("close", 20), "ma50": ma("close", 50), "ma200": ma("close", 200), "v5": f"CASE WHEN count(volume) {over(5)} >= 5 THEN min(volume) {over(5)} END"}
_NEAREST = "CASE WHEN ma50 IS NOT NULL THEN CASE WHEN close < ma20 AND close < ma50 THEN 0 WHEN abs(close - ma20) <= abs(close - ma50) THEN 20 ELSE 50 END END::BIGINT"


@query(
    "e04_time_series_sheet",
    staged([_MA | {"c1": lag("close")}], KEYS | {"close": r("close"), "volume": "volume", "day_change": r("100 * (close / c1 - 1)"), "ma20": r("ma20"), "ma50": r("ma50"), "ma200": r("ma200"), "nearest_ma": _NEAREST, "above_long": "CASE WHEN ma200 IS NOT NULL THEN (close > ma200)::BIGINT END"}, tail=f"WHERE v5 >= {LEAST_VOLUME} AND ts >= DATE '1996-01-01'"),
)
def time_series_sheet(spark, d, since: datetime.date = datetime.date(1996, 1, 1), least: float = LEAST_VOLUME):
    """The flagship slice: averages, the nearest of them, and the day's change of liquid tickers."""
    f = framed(spark, d)
    f.add(day_change=f.roc("close", 1), ma20=f.ma("close", 20), ma50=f.ma("close", 50), ma200=f.ma("close", 200), **ind.nearest_ma(f))
    keep = f.hold(liquid(f, least))
    return tidy(f.df.where(keep & (F.col("ts") >= F.lit(since))).select("ticker", "ts", "close", "volume", "day_change", "ma20", "ma50", "ma200", "nearest_ma", "above_long"))


@query("e01_share_master", f"WITH {BARS_SQL}, l AS (SELECT ticker, arg_max(close, ts) AS close, max(ts) AS ts FROM bars GROUP BY ticker), d AS (SELECT 'S' || s_suppkey AS ticker, s_name AS full_name, n_name AS industry, r_name AS market, s_acctbal FROM supplier LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON s_nationkey = n_nationkey) SELECT l.ticker, l.ts, {r('l.close')} AS close, full_name, industry, market, {r('s_acctbal * l.close', 0)} AS capital, {r('CASE WHEN s_acctbal > 0 THEN l.close / s_acctbal END')} AS pe FROM l LEFT JOIN d USING (ticker)")
def _(spark, d):
    """Last bar of each share with its dimension; the price-earnings ratio is null unless earnings are positive."""
    last = bars_eod(spark, d).groupBy("ticker").agg(F.max_by("close", "ts").alias("close"), F.max("ts").alias("ts"))
    rows = last.join(dimension(spark, d), "ticker", "left").withColumns({"capital": F.col("balance") * F.col("close"), "pe": F.when(F.col("balance") > 0, F.col("close") / F.col("balance"))})
    return tidy(rows.select("ticker", "ts", "close", "full_name", "industry", "market", "capital", "pe"), capital=0)


@query("e05_intraday_sheet", f"WITH {INTRADAY_SQL.format(width='1 hour')}, s AS (SELECT *, lag(low, 5) {W} AS l5, lag(low, 20) {W} AS l20, CASE WHEN count(volume) {over(20)} >= 20 THEN avg(volume) {over(20)} END AS mv FROM intraday), t AS (SELECT *, lag(mv) {W} AS mv1 FROM s) SELECT ticker, ts, {r('close')} AS close, volume, {r('100 * (close / nullif(l5, 0) - 1)')} AS week_change, {r('100 * (close / nullif(l20, 0) - 1)')} AS month_change, {r('volume / mv1')} AS volume_ratio FROM t WHERE ts >= TIMESTAMP '2024-01-10'")
def _(spark, d):
    f = Frame(bars_intraday(spark, d))
    change = lambda n: 100 * (F.try_divide(F.col("close"), f.ref("low", -n)) - 1)
    f.add(week_change=change(5), month_change=change(20), volume_ratio=ind.volume_measures(f)["volume_ratio"])
    return tidy(f.df.where("ts >= timestamp '2024-01-10'").select("ticker", "ts", "close", "volume", "week_change", "month_change", "volume_ratio"))


@query("e06_flow_sheet", "SELECT * FROM (SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS ts, coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) - coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS net_qty FROM lineitem GROUP BY ALL) WHERE net_qty <> 0 AND ts >= DATE '2000-01-01'")
def _(spark, d):
    rows = flows(spark, d).withColumn("net_qty", F.col("buy_qty") - F.col("sell_qty"))
    return rows.where("net_qty <> 0 and ts >= date '2000-01-01'").select("ticker", "ts", "net_qty")


@query("e07_statistics_sheet", f"WITH {BARS_SQL} SELECT ticker, ts, {r('open')} AS open, {r('high')} AS high, {r('low')} AS low, {r('close')} AS close, volume FROM bars WHERE ts >= DATE '2001-06-01'")
def _(spark, d):
    return tidy(bars_eod(spark, d).where("ts >= date '2001-06-01'"))


_IXW = f"WITH {BARS_SQL}, ix AS (SELECT ts, sum(close * volume) / sum(volume) AS c FROM bars GROUP BY ts), p AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS ts, arg_min(c, ts) AS o, max(c) AS h, min(c) AS l, arg_max(c, ts) AS c FROM ix GROUP BY 1)"


@query("e08_index_weekly", f"{_IXW} SELECT ts, {r('o')} AS open, {r('h')} AS high, {r('l')} AS low, {r('c')} AS close, {r('100 * (c / lag(c) OVER (ORDER BY ts) - 1)')} AS week_change FROM p")
def _(spark, d):
    ix = index_series(bars_eod(spark, d)).select(F.lit("INDEX").alias("ticker"), "ts", *[F.col("index_close").alias(c) for c in ("open", "high", "low", "close")], F.col("index_volume").alias("volume"))
    f = Frame(timeframes.compress(ix, "W"))
    return tidy(f.add(week_change=f.roc("close", 1)).df.select("ts", "open", "high", "low", "close", "week_change"))


@query("e09_working_days", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS ts FROM orders WHERE o_orderdate >= DATE '1996-01-01'")
def _(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").where("o_orderdate >= date '1996-01-01'").select(F.to_date("o_orderdate").alias("ts")).distinct()


@query("e15_gap_scanner", staged([{"h1": lag("high"), "l1": lag("low")}], KEYS | {"gap": "CASE WHEN open > h1 THEN 'up' ELSE 'down' END", "percent": r("CASE WHEN open > h1 THEN 100 * (open / h1 - 1) ELSE 100 * (open / l1 - 1) END")}, tail="WHERE open > h1 OR open < l1"))
def _(spark, d):
    f = framed(spark, d)
    h1, l1, o = f.hold(f.ref("high", -1)), f.hold(f.ref("low", -1)), F.col("open")
    f.add(gap=F.when(o > h1, "up").otherwise("down"), percent=F.when(o > h1, 100 * (o / h1 - 1)).otherwise(100 * (o / l1 - 1)))
    return tidy(f.df.where((o > h1) | (o < l1)).select("ticker", "ts", "gap", "percent"))


@query("e16_high_beta", staged([{"own": "100 * (close / " + lag("close") + " - 1)", "mkt": "100 * (index_close / " + lag("index_close") + " - 1)"}, {"beta": f"CASE WHEN count(CASE WHEN own IS NOT NULL AND mkt IS NOT NULL THEN 1 END) {over(60)} >= 60 THEN regr_slope(own, mkt) {over(60)} END"}], KEYS | {"beta": r("beta", 3)}, source="j", ctes=f"{BARS_SQL}, ix AS (SELECT ts, sum(close * volume) / sum(volume) AS index_close FROM bars GROUP BY ts), j AS (SELECT * FROM bars JOIN ix USING (ts))", tail="WHERE beta >= 1.2"))
def _(spark, d):
    bars = bars_eod(spark, d)
    f = Frame(crosssection.with_index(bars, index_series(bars)))
    return tidy(f.add(beta=crosssection.beta(f, "index_close")).df.where("beta >= 1.2").select("ticker", "ts", "beta"), beta=3)


@query("e21_all_returns", staged([], KEYS | {f"roc{n}": r(f"100 * (close / {lag('close', n)} - 1)") for n in (1, 5, 10, 20, 60, 120, 250)} | {f"position{n}": r(f"100 * (close - ({llv('low', n)})) / nullif(({hhv('high', n)}) - ({llv('low', n)}), 0)") for n in (20, 60, 250)}))
def _(spark, d):
    f = framed(spark, d)
    return out(f, {f"roc{n}": f.roc("close", n) for n in (1, 5, 10, 20, 60, 120, 250)} | {f"position{n}": ind.range_position(f, n) for n in (20, 60, 250)})


@query("e26_slope_angles", staged([{"i": f"CAST(row_number() {W} - 1 AS DOUBLE)"}, {f"s{n}": full("regr_slope(close, i) {w}", "close", n) for n in (5, 20, 60)}], KEYS | {f"angle{n}": r(f"degrees(atan(s{n}))", 2) for n in (5, 20, 60)}))
def _(spark, d):
    f = framed(spark, d)
    return out(f, {f"angle{n}": F.degrees(F.atan(f.hold(f.slope("close", n)))) for n in (5, 20, 60)}, 2)


@query("e28_three_averages", staged([{"a": ma("close", 5), "b": ma("close", 20), "c": ma("close", 50)}, {"a1": lag("a"), "b1": lag("b"), "c1": lag("c")}], KEYS | {"fast_cross": "coalesce(a > b AND a1 <= b1, false)::BIGINT", "slow_cross": "coalesce(b > c AND b1 <= c1, false)::BIGINT", "stacked": "coalesce(a > b AND b > c, false)::BIGINT"}))
def _(spark, d):
    f = framed(spark, d)
    a, b, c = (f.hold(f.ma("close", n)) for n in (5, 20, 50))
    return out(f, {"fast_cross": f.cross(a, b), "slow_cross": f.cross(b, c), "stacked": F.coalesce((a > b) & (b > c), F.lit(False))})


@query("e33_price_distribution", f"WITH {BARS_SQL}, m AS (SELECT ticker, min(close) AS lo, max(close) AS hi FROM bars GROUP BY ticker) SELECT ticker, CAST(least(19, floor((close - lo) / nullif(hi - lo, 0) * 20)) AS BIGINT) AS bucket, count(*) AS n FROM bars JOIN m USING (ticker) WHERE hi > lo GROUP BY ALL")
def _(spark, d):
    """Bars of each ticker in 20 equal price bins."""
    bars = bars_eod(spark, d)
    ends = bars.groupBy("ticker").agg(F.min("close").alias("lo"), F.max("close").alias("hi")).where("hi > lo")
    bucket = F.least(F.lit(19), F.floor((F.col("close") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 20))
    return bars.join(ends, "ticker").groupBy("ticker", bucket.cast("long").alias("bucket")).agg(F.count("*").alias("n"))


@query("e36_stack_pullback")
def _(spark, d):
    """EMA 20 over EMA 50, MA 100 over MA 200, close under EMA 20, %K under 20."""
    f = Frame(scan(bars_eod(spark, d), {"ema20": lambda b: k.ema(b.c, 20), "ema50": lambda b: k.ema(b.c, 50), "k14": lambda b: k.stoch_k(b)}))
    f.add(ma100=f.ma("close", 100), ma200=f.ma("close", 200))
    return tidy(f.df.where("ema20 > ema50 and ma100 > ma200 and close < ema20 and k14 < 20").select("ticker", "ts", "close", "ema20", "ema50", "k14"))


@query("e18_rsi_targets")
def _(spark, d):
    return tidy(scan(bars_eod(spark, d), {"rsi": lambda b: k.rsi(b.c, 14), **{f"price_{t}": (lambda b, t=t: k.rsi_price(b.c, 14, t)) for t in (30, 50, 70)}}).select("ticker", "ts", "close", "rsi", "price_30", "price_50", "price_70"))


@query("e19_atr_rank")
def _(spark, d):
    f = Frame(scan(bars_eod(spark, d), {"atr": lambda b: k.atr(b, 14)}))
    return out(f, {"atr_rank": f.percent_rank(f.hold(f.linreg("atr", 10)), 100)})


@query("e24_rsi_ema_cross")
def _(spark, d):
    f = Frame(scan(bars_eod(spark, d), {"rsi": lambda b: k.rsi(b.c, 14), "e5": lambda b: k.ema(b.c, 5), "e20": lambda b: k.ema(b.c, 20), "tema9": lambda b: k.tema(b.c, 9), "tema20": lambda b: k.tema(b.c, 20)}))
    return out(f, {"ema_cross": f.cross("e5", "e20"), "tema_cross": f.cross("tema9", "tema20"), "rsi_cross": f.cross("rsi", F.lit(50.0))}).where("ema_cross + tema_cross + rsi_cross > 0")


@query("e25_adx_scanner")
def _(spark, d):
    f = Frame(scan(bars_eod(spark, d), {"adx": lambda b: k.directional(b)[2], "plus": lambda b: k.directional(b)[0], "minus": lambda b: k.directional(b)[1]}))
    f.add(up=f.cross("plus", "minus"), label=F.when(F.col("adx") > 40, "strong").when(F.col("adx") > 25, "trend").when(F.col("adx") > 15, "weak").otherwise("none"))
    return tidy(f.df.where("adx > 25").select("ticker", "ts", "adx", "up", "label"))


@query("e27_wave_trend_15m")
def _(spark, d):
    f = Frame(scan(bars_intraday(spark, d, "15 minutes"), {"wt": lambda b: k.wave_trend(b)}))
    line = f.hold(f.ma("wt", 4))
    return out(f, {"wt": F.col("wt"), "wt_line": line, "wt_up": f.cross("wt", line), "wt_down": f.cross(line, "wt")})


@query("q_volume_price_sheet", vpa_sql.SHEET)
def _(spark, d):
    steps = {n: s for n, s in vpa.STEPS.items() if n not in ("mean_spread", "mean_result")}
    f = vpa.scanned(bars_eod(spark, d), steps, **vpa.FORCE_STEPS)
    return out(f, {**vpa.sheet(f), **{n: F.col(n) for n in vpa.FORCE_STEPS}}, 3)


@query("q_classes", vpa_sql.CLASS_SQL)
def _(spark, d):
    f = vpa.scanned(bars_eod(spark, d).drop("open"), vpa.CLASS_STEPS)
    return out(f, vpa.texts(vpa.class_terms()))


_AHEAD = f"OVER ({SPEC} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
_PIVOTS = staged(
    [{"i": f"row_number() {W} - 1", "top": f"coalesce(high = ({hhv('high', 10)}) AND count(high) {_AHEAD} = 5 AND max(high) {_AHEAD} < high, false)", "bot": f"coalesce(low = ({llv('low', 10)}) AND count(low) {_AHEAD} = 5 AND min(low) {_AHEAD} > low, false)"}],
    {"ticker": "ticker", "ts": "ts", "bar": "i", "side": "CASE WHEN top THEN 1 ELSE -1 END", "price": "CASE WHEN top THEN high ELSE low END"}, tail="WHERE top OR bot",
)
_PIVOT_ROWS = f"""WITH raw AS ({_PIVOTS}), n AS (SELECT *, CASE WHEN side = lag(side) OVER (PARTITION BY ticker ORDER BY bar) THEN 0 ELSE 1 END AS fresh FROM raw),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY ticker ORDER BY bar ROWS UNBOUNDED PRECEDING) AS island FROM n),
pv AS (SELECT ticker, ts, bar, side, price FROM (SELECT *, row_number() OVER (PARTITION BY ticker, island ORDER BY side * price DESC, bar) AS nth FROM g) WHERE nth = 1)"""


@query("c_pivots", f"{_PIVOT_ROWS} SELECT ticker, ts, bar, side, {r('price')} AS price, CASE WHEN side = 1 THEN CASE WHEN abs(price - b) <= b * 0.5 / 100 THEN 'DT' WHEN price > b THEN 'HH' WHEN price < b THEN 'LH' END ELSE CASE WHEN abs(price - b) <= b * 0.5 / 100 THEN 'DB' WHEN price > b THEN 'HL' WHEN price < b THEN 'LL' END END AS label FROM (SELECT *, lag(price) OVER (PARTITION BY ticker, side ORDER BY bar) AS b FROM pv)")
def _(spark, d):
    return tidy(patterns.swing_labels(patterns.pivot_rows(framed(spark, d))))


@query("c_harmonics")
def _(spark, d):
    return tidy(patterns.harmonics(patterns.pivot_rows(framed(spark, d))))


@query("c_wolfe_waves")
def _(spark, d):
    return tidy(patterns.wolfe_waves(patterns.pivot_rows(framed(spark, d))))


@query(
    "c_range_breaks",
    staged([{"hh": hhv("high", 20), "ll": llv("low", 20), "mv": ma("volume", 20)}, {"u": f"coalesce(close > {lag('hh')}, false) AND coalesce(volume > 1.5 * {lag('mv')}, false)", "dn": f"coalesce(close < {lag('ll')}, false) AND coalesce(volume > 1.5 * {lag('mv')}, false)"}],
           KEYS | {n: f"({c} AND coalesce(max({c}::INT) OVER ({SPEC} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) = 0)::BIGINT" for n, c in (("range_up", "u"), ("range_down", "dn"))} | {"sideways": "coalesce(100 * (hh - ll) / ll < 50, false)::BIGINT"}),
)
def _(spark, d):
    f = framed(spark, d)
    return out(f, {**patterns.range_break(f), "sideways": patterns.sideways(f, 20, 50)})


@query("c_level_breaks", f"WITH {BARS_SQL}, lv AS (SELECT ticker, avg(close) AS level FROM bars GROUP BY ticker), s AS (SELECT *, {lag('close')} AS b FROM bars) SELECT ticker, ts, kind, {r('level')} AS level, {r('close')} AS close FROM s JOIN lv USING (ticker), (VALUES ('up'), ('down')) k(kind) WHERE (kind = 'up' AND b <= level AND close > level) OR (kind = 'down' AND b >= level AND close < level)")
def _(spark, d):
    bars = bars_eod(spark, d)
    levels = bars.groupBy("ticker").agg(F.avg("close").alias("price")).select("ticker", F.explode(F.array(F.lit("up"), F.lit("down"))).alias("kind"), "price")
    return tidy(patterns.level_breaks(Frame(bars), levels))
