"""Queries across tickers, time frames, trades and recurrences."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tickloom.functions import recur as k
from tickloom.functions.frame import Frame
from tickloom.operators import candles, crosssection, timeframes, trades
from tickloom.operators.scan import scan
from tickloom.plans.bars import BARS_SQL, INTRADAY_SQL, bars_eod, bars_intraday, dimension, flows, index_series
from tickloom.plans.series_queries import framed, out, tidy
from tickloom.plans.sqltext import KEYS, SO_FAR, SPEC, W, div, full, hhv, lag, llv, ma, over, r, rounded, staged

QUERIES, SQL = {}, {}
BASE = datetime.date(1998, 1, 1)
LIST = "S1,S2,S3,S5,S8"


def query(name: str, sql: str | None = None):
    def register(make):
        QUERIES[name] = make
        if sql:
            SQL[name] = sql
        return make

    return register


_BREADTH = """, d AS (SELECT *, close - lag(close) OVER (PARTITION BY ticker ORDER BY ts) AS ch FROM bars),
b AS (SELECT ts, count(*) FILTER (ch > 0) AS advancing, count(*) FILTER (ch < 0) AS declining, count(*) FILTER (ch = 0) AS unchanged,
  CAST(sum(CASE WHEN ch > 0 THEN volume ELSE 0 END) AS BIGINT) AS up_volume, CAST(sum(CASE WHEN ch < 0 THEN volume ELSE 0 END) AS BIGINT) AS down_volume FROM d GROUP BY ts)"""


@query("x_breadth", f"WITH {BARS_SQL}{_BREADTH} SELECT *, abs(advancing - declining) AS absolute_breadth, {r(div('advancing', 'declining'))} AS ad_ratio, {r(div('advancing', 'advancing + declining'))} AS thrust, {r(div(div('advancing', 'declining'), div('up_volume', 'down_volume')))} AS trin, CAST(sum(advancing - declining) OVER (ORDER BY ts) AS BIGINT) AS ad_line FROM b")
def _(spark, d):
    return tidy(crosssection.ad_line(crosssection.breadth(bars_eod(spark, d))))


@query("x_percent_above_ma", f"WITH {BARS_SQL}, m AS (SELECT *, {ma('close', 10)} AS m FROM bars) SELECT ts, {r('100 * avg((close > m)::INT)')} AS percent_above FROM m WHERE m IS NOT NULL GROUP BY ts")
def _(spark, d):
    return tidy(crosssection.percent_above_ma(bars_eod(spark, d)))


_INDEX = "ix AS (SELECT ts, sum(close * volume) / sum(volume) AS index_close FROM bars GROUP BY ts)"


@query(
    "x_beta_relative",
    staged([{"own": "100 * (close / " + lag("close") + " - 1)", "mkt": "100 * (index_close / " + lag("index_close") + " - 1)"}], KEYS | {"beta": r(f"CASE WHEN count(CASE WHEN own IS NOT NULL AND mkt IS NOT NULL THEN 1 END) {over(60)} >= 60 THEN regr_slope(own, mkt) {over(60)} END", 3), "relative": r("close / index_close")}, source="j", ctes=f"{BARS_SQL}, {_INDEX}, j AS (SELECT * FROM bars JOIN ix USING (ts))"),
)
def _(spark, d):
    bars = bars_eod(spark, d)
    f = Frame(crosssection.with_index(bars, index_series(bars)))
    return out(f, {"beta": crosssection.beta(f, "index_close"), "relative": F.col("close") / F.col("index_close")}, beta=3)


@query(
    "x_strength_rank",
    staged([{"score": f"0.4 * (100 * (close / {lag('close', 65)} - 1)) + 0.3 * (100 * (close / {lag('close', 130)} - 1)) + 0.3 * (100 * (close / {lag('close', 260)} - 1))"}], KEYS | {"score": r("score"), "strength": r("100 * percent_rank() OVER (PARTITION BY ts ORDER BY score)")}, tail="WHERE score IS NOT NULL"),
)
def _(spark, d):
    from tickloom.operators.indicators import weighted_roc

    f = framed(spark, d)
    return tidy(crosssection.strength_rank(f.add(score=weighted_roc(f)).df).select("ticker", "ts", "score", "strength"))


@query("x_rotation_top3", staged([{"score": f"100 * (close / {lag('close', 20)} - 1)"}, {"place": "row_number() OVER (PARTITION BY ts ORDER BY score DESC, ticker)"}], KEYS | {"place": "place", "score": r("score")}, tail="WHERE score IS NOT NULL AND place <= 3").replace("s2 AS (SELECT *, row_number()", "s2 AS (SELECT *, row_number()").replace("FROM s1)", "FROM s1 WHERE score IS NOT NULL)"))
def _(spark, d):
    f = framed(spark, d)
    return tidy(crosssection.top_k(f.add(score=f.roc("close", 20)).df, "score", 3).select("ticker", "ts", "place", "score"))


@query("x_relative_performance", f"WITH {BARS_SQL}, s AS (SELECT ticker, arg_min(close, ts) AS base_close FROM bars WHERE ts >= DATE '1998-01-01' GROUP BY ticker) SELECT ticker, ts, {r('100 * (close / base_close - 1)')} AS performance FROM bars JOIN s USING (ticker) WHERE ts >= DATE '1998-01-01'")
def _(spark, d):
    return tidy(crosssection.relative_performance(bars_eod(spark, d), F.lit(BASE)).select("ticker", "ts", "performance"))


@query("x_spread", f"WITH {BARS_SQL} SELECT a.ts, {r('a.close - b.close')} AS spread, {r('a.close / b.close')} AS ratio FROM bars a JOIN bars b ON a.ts = b.ts AND a.ticker = 'S1' AND b.ticker = 'S2'")
def _(spark, d):
    return tidy(crosssection.spread(bars_eod(spark, d), "S1", "S2").select("ts", "spread", "ratio"))


_IN = "('" + "','".join(LIST.split(",")) + "')"


@query("x_basket", f"WITH {BARS_SQL} SELECT ts, " + ", ".join(f"{r(f'sum({c} * volume) / sum(volume)')} AS {c}" for c in ("open", "high", "low", "close")) + f", CAST(sum(volume) AS BIGINT) AS volume FROM bars WHERE ticker IN {_IN} GROUP BY ts")
def _(spark, d):
    return tidy(crosssection.basket(bars_eod(spark, d), LIST))


_LISTED = f"""{BARS_SQL}, listed(b) AS (VALUES {", ".join(f"('{s}')" for s in LIST.split(","))}),
l AS (SELECT d.ts, b, last_value(bars.close IGNORE NULLS) OVER (PARTITION BY b ORDER BY d.ts ROWS UNBOUNDED PRECEDING) AS y
 FROM (SELECT DISTINCT ts FROM bars) d CROSS JOIN listed LEFT JOIN bars ON bars.ts = d.ts AND bars.ticker = b),
p AS (SELECT ticker, ts, close, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS nth FROM bars)"""


@query("x_correlations", f"WITH {_LISTED} SELECT ticker AS a, b, {r('CASE WHEN count(y) >= 252 THEN covar_pop(close, y) / nullif(stddev_pop(close) * stddev_pop(y), 0) END', 3)} AS corr, count(y) AS n FROM p JOIN l USING (ts) WHERE nth <= 252 GROUP BY ticker, b")
def _(spark, d):
    """Every ticker against each symbol of the list, over its last 252 bars."""
    return tidy(crosssection.correlations(bars_eod(spark, d), LIST), 3)


@query("x_risk_yield", f"WITH {BARS_SQL}, c AS (SELECT ticker, 100 * (close / {lag('close')} - 1) AS ch FROM bars) SELECT ticker, {r('avg(ch)', 3)} AS mean_return, {r('stddev_samp(ch)', 3)} AS risk, count(ch) AS n FROM c GROUP BY ticker")
def _(spark, d):
    return tidy(crosssection.risk_yield(bars_eod(spark, d)), 3)


def _compressed(unit: str, ctes: str = BARS_SQL) -> str:
    return f"{ctes}, p AS (SELECT ticker, CAST(date_trunc('{unit}', ts) AS DATE) AS p, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume, max(ts) AS last_ts FROM bars GROUP BY ALL)"


for _frame, _unit in (("W", "week"), ("M", "month")):

    @query(f"t_compress_{_unit}", f"WITH {_compressed(_unit)} SELECT ticker, p AS ts, {r('open')} AS open, {r('high')} AS high, {r('low')} AS low, {r('close')} AS close, volume, last_ts FROM p")
    def _(spark, d, frame=_frame):
        return tidy(timeframes.compress(bars_eod(spark, d), frame))


@query("t_prior_month_levels", f"WITH {_compressed('month')}, q AS (SELECT ticker, p, lag(high) OVER (PARTITION BY ticker ORDER BY p) AS h, lag(low) OVER (PARTITION BY ticker ORDER BY p) AS l, lag(close) OVER (PARTITION BY ticker ORDER BY p) AS c FROM p) SELECT b.ticker, b.ts, {r('(h + l + c) / 3')} AS pivot, {r('c + (h - l) * 1.1 / 2')} AS cam_r4, {r('h')} AS month_high FROM bars b LEFT JOIN q ON q.ticker = b.ticker AND q.p = CAST(date_trunc('month', b.ts) AS DATE)")
def _(spark, d):
    from tickloom.operators.indicators import pivots_of

    bars = bars_eod(spark, d)
    month = timeframes.compress(bars, "M").withColumnsRenamed({"high": "h", "low": "l", "close": "c"})
    p = timeframes.expand(bars.select("ticker", "ts"), month, "M", ["h", "l", "c"])
    levels = pivots_of("h", "l", "c")
    return tidy(p.select("ticker", "ts", levels["pivot"].alias("pivot"), levels["cam_r4"].alias("cam_r4"), F.col("h").alias("month_high")))


@query("t_intraday_bars", f"WITH {INTRADAY_SQL.format(width='15 minutes')} SELECT ticker, ts, {', '.join(f'{r(c)} AS {c}' for c in ('open', 'high', 'low', 'close'))}, volume FROM intraday")
def _(spark, d):
    return tidy(bars_intraday(spark, d, "15 minutes"))


@query("t_session_flags", f"WITH {INTRADAY_SQL.format(width='1 hour')} SELECT ticker, ts, coalesce(ts::DATE <> lag(ts::DATE) {W}, true)::BIGINT AS new_session, coalesce(ts::DATE <> lead(ts::DATE) {W}, true)::BIGINT AS last_of_session, (ts::DATE = last_day(ts::DATE) - CAST((dayofweek(last_day(ts::DATE)) + 3) % 7 AS INT))::BIGINT AS expiry FROM intraday")
def _(spark, d):
    f = Frame(bars_intraday(spark, d, "1 hour"))
    return out(f, {**timeframes.session_flags(f), "expiry": timeframes.last_thursday()})


@query("g_buy_and_hold", f"WITH {BARS_SQL} SELECT ticker, {r('arg_min(close, ts)')} AS first_close, {r('arg_max(close, ts)')} AS final_close, count(*) AS n_bars, {r('100 * (arg_max(close, ts) / arg_min(close, ts) - 1)')} AS hold_return FROM bars GROUP BY ticker")
def _(spark, d):
    return tidy(trades.buy_and_hold(bars_eod(spark, d)))


_MONTHS = f"WITH {BARS_SQL}, m AS (SELECT ticker, year(ts) AS year, month(ts) AS month, arg_max(close, ts) AS close FROM bars GROUP BY ALL), g AS (SELECT *, 100 * (close / lag(close) OVER (PARTITION BY ticker ORDER BY year, month) - 1) AS monthly FROM m)"


@query("g_monthly_returns", f"{_MONTHS} SELECT ticker, year, month, {r('close')} AS close, {r('monthly')} AS monthly FROM g")
def _(spark, d):
    return tidy(trades.monthly_returns(bars_eod(spark, d)))


@query("g_return_table", f"{_MONTHS} SELECT year, " + ", ".join(f"{r(f'avg(monthly) FILTER (month = {m})', 3)} AS \"m{m}\"" for m in range(1, 13)) + " FROM g GROUP BY year")
def _(spark, d):
    t = trades.return_table(trades.monthly_returns(bars_eod(spark, d)))
    return tidy(t.select("year", *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)]), 3)


@query("g_range_statistics", f"WITH {BARS_SQL} SELECT ticker, max(ts) - min(ts) AS days, count(*) AS n_bars, {r('100 * (arg_max(close, ts) / arg_min(close, ts) - 1)')} AS gain FROM bars WHERE ts BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' GROUP BY ticker")
def _(spark, d):
    return tidy(trades.range_statistics(bars_eod(spark, d), F.lit(BASE), F.lit(datetime.date(1999, 12, 31))))


_LEDGER = staged(
    [{"hh": hhv("high", 10), "ll": llv("low", 10)}, {"a": f"coalesce(close > {lag('hh')}, false)", "b": f"coalesce(close < {lag('ll')}, false)", "nx": f"lead(open) {W}", "nt": f"lead(ts) {W}"}, {"st": "CASE WHEN a AND NOT b THEN 1 WHEN b THEN 0 END"},
     {"held": f"coalesce(last_value(st IGNORE NULLS) {SO_FAR}, 0)"}, {"was": f"coalesce(lag(held) {W}, 0)"}],
    {"*": "*"},
).replace("SELECT * AS * FROM s5", "SELECT ticker, entry_ts, entry_price, exit_ts, exit_price, exit_price / entry_price - 1 AS profit FROM (SELECT ticker, held, nt AS entry_ts, nx AS entry_price, lead(nt) OVER (PARTITION BY ticker ORDER BY ts) AS exit_ts, lead(nx) OVER (PARTITION BY ticker ORDER BY ts) AS exit_price FROM s5 WHERE held <> was) WHERE held = 1 AND entry_ts IS NOT NULL")


def _trades(spark, d):
    f = framed(spark, d)
    hh, ll = f.hold(f.hhv("high", 10)), f.hold(f.llv("low", 10))
    a, b = f.hold(F.coalesce(F.col("close") > f.ref(hh, -1), F.lit(False))), f.hold(F.coalesce(F.col("close") < f.ref(ll, -1), F.lit(False)))
    return trades.ledger(f, a, b)


@query("g_ledger", f"SELECT ticker, entry_ts, {r('entry_price')} AS entry_price, exit_ts, {r('exit_price')} AS exit_price, {r('profit')} AS profit FROM ({_LEDGER})")
def _(spark, d):
    return tidy(_trades(spark, d))


@query("g_excursions", f"WITH t AS ({_LEDGER}), {BARS_SQL} SELECT ticker, entry_ts, {r('profit')} AS profit, count(*) AS length, {r('min(100 * (low / entry_price - 1))')} AS mae, {r('max(100 * (high / entry_price - 1))')} AS mfe FROM t JOIN bars USING (ticker) WHERE exit_ts IS NOT NULL AND ts >= entry_ts AND ts < exit_ts GROUP BY ticker, entry_ts, entry_price, exit_ts, profit")
def _(spark, d):
    return tidy(trades.excursions(_trades(spark, d), bars_eod(spark, d)).select("ticker", "entry_ts", "profit", "length", "mae", "mfe"))


@query("g_equity", f"WITH t AS ({_LEDGER}), e AS (SELECT *, exp(sum(ln(1 + profit)) OVER (PARTITION BY ticker ORDER BY exit_ts, entry_ts ROWS UNBOUNDED PRECEDING)) AS equity FROM t WHERE profit IS NOT NULL) SELECT ticker, exit_ts, {r('equity')} AS equity, {r('100 * (equity / greatest(1, max(equity) OVER (PARTITION BY ticker ORDER BY exit_ts, entry_ts ROWS UNBOUNDED PRECEDING)) - 1)', 3)} AS drawdown FROM e")
def _(spark, d):
    return tidy(trades.equity(_trades(spark, d)).select("ticker", "exit_ts", "equity", "drawdown"), drawdown=3)


# -- recurrences: recursive SQL walks the bars of all tickers side by side ---------------
_WALK = f"""{BARS_SQL}, b AS MATERIALIZED (SELECT *, row_number() {W} AS i, lag(close) {W} AS c1, greatest(high, coalesce(lag(close) {W}, high)) - least(low, coalesce(lag(close) {W}, low)) AS tr FROM bars),
e AS (SELECT ticker, ts, i, close AS e12, close AS e26, close AS e9x, tr AS atr, CAST(0 AS DOUBLE) AS sig, open AS ho, (open + high + low + close) / 4 AS hc FROM b WHERE i = 1
 UNION ALL SELECT b.ticker, b.ts, b.i, e12 + (close - e12) * 2 / 13, e26 + (close - e26) * 2 / 27, e9x + (close - e9x) * 2 / 10, e.atr + (b.tr - e.atr) / 14,
   sig + ((e12 + (close - e12) * 2 / 13) - (e26 + (close - e26) * 2 / 27) - sig) * 2 / 10, (ho + hc) / 2, (open + high + low + close) / 4 FROM e JOIN b ON b.ticker = e.ticker AND b.i = e.i + 1)"""


@query("r_ema_macd_atr", f"WITH RECURSIVE {_WALK} SELECT ticker, ts, {r('e12')} AS ema12, {r('e9x')} AS ema9, {r('e12 - e26')} AS macd, {r('sig')} AS macd_signal, {r('atr')} AS atr FROM e")
def _(spark, d):
    return tidy(scan(bars_eod(spark, d), {"ema12": lambda b: k.ema(b.c, 12), "ema9": lambda b: k.ema(b.c, 9), "macd": lambda b: k.macd(b.c), "macd_signal": lambda b: k.macd_signal(b.c), "atr": lambda b: k.atr(b, 14)}).select("ticker", "ts", "ema12", "ema9", "macd", "macd_signal", "atr"))


_RSI = f"""{BARS_SQL}, b AS MATERIALIZED (SELECT *, row_number() {W} AS i, close - lag(close) {W} AS ch FROM bars),
u AS MATERIALIZED (SELECT *, avg(greatest(ch, 0)) {over(14)} AS g0, avg(greatest(-ch, 0)) {over(14)} AS l0 FROM b WHERE ch IS NOT NULL),
e AS (SELECT ticker, ts, i, g0 AS g, l0 AS l FROM u WHERE i = 15
 UNION ALL SELECT u.ticker, u.ts, u.i, g + (greatest(ch, 0) - g) / 14, l + (greatest(-ch, 0) - l) / 14 FROM e JOIN u ON u.ticker = e.ticker AND u.i = e.i + 1)"""


@query("r_rsi", f"WITH RECURSIVE {_RSI} SELECT b.ticker, b.ts, {r('100 * g / nullif(g + l, 0)')} AS rsi FROM b LEFT JOIN e ON e.ticker = b.ticker AND e.i = b.i")
def _(spark, d):
    return tidy(scan(bars_eod(spark, d), {"rsi": lambda b: k.rsi(b.c, 14)}).select("ticker", "ts", "rsi"))


RECURRENCES = {
    "averages": {"wilders": lambda b: k.wilders(b.c, 14), "smma": lambda b: k.smma(b.c, 14), "dema": lambda b: k.dema(b.c, 10), "tema": lambda b: k.tema(b.c, 10), "t3": lambda b: k.t3(b.c, 5), "zlma": lambda b: k.zero_lag_ma(b.c, 10), "zltema": lambda b: k.zero_lag_tema(b.c, 10), "alma": lambda b: k.alma(b.c), "hma": lambda b: k.hma(b.c, 9), "displaced": lambda b: k.average("ema", b.c, 10, -3), **{f"guppy{n}": (lambda b, n=n: k.ema(b.c, n)) for n in (3, 5, 8, 10, 12, 15, 30, 35, 40, 45, 50, 60)}},
    "oscillators": {"stoch_rsi": lambda b: k.stoch_rsi(b.c), "zero_lag_rsi": lambda b: k.zero_lag_rsi(b.c), "zone_top": lambda b: k.dynamic_zones(b.c)[0], "zone_low": lambda b: k.dynamic_zones(b.c)[1], "sentimental": lambda b: k.sentimental_rsi(b), "hull_rsi": lambda b: k.hull_rsi(b), "rmi": lambda b: k.rmi(b.c), "trix": lambda b: k.trix(b.c), "tsi": lambda b: k.tsi(b.c), "smi": lambda b: k.stoch_momentum(b), "dss": lambda b: k.double_stoch(b), "plus_di": lambda b: k.directional(b)[0], "minus_di": lambda b: k.directional(b)[1], "adx": lambda b: k.directional(b)[2], "vortex_plus": lambda b: k.vortex(b)[0], "vortex_minus": lambda b: k.vortex(b)[1], "vortex_adx": lambda b: k.vortex_adx(b), "mass": lambda b: k.mass_index(b), "oscp": lambda b: k.price_oscillator(b.c), "wave_trend": lambda b: k.wave_trend(b), "rahul": lambda b: k.rahul_mohindar(b.c)[0], "bull": lambda b: k.bull_bear(b)[0], "bear": lambda b: k.bull_bear(b)[1], "banker": lambda b: k.mcdx(b.c, 50, 1.5, 50), "hot_money": lambda b: k.mcdx(b.c, 30, 0.7, 40), "schaff": lambda b: k.schaff(b.c), "efficiency": lambda b: k.polarized_efficiency(b.c), "two_poles": lambda b: k.two_poles(b.c), "rsi_70": lambda b: k.rsi_price(b.c, 14, 70), "rsi_30": lambda b: k.rsi_price(b.c, 14, 30)},
    "volume": {"chaikin": lambda b: k.chaikin(b), "chaikin_volatility": lambda b: k.chaikin_volatility(b), "eom": lambda b: k.ease_of_movement(b), "klinger": lambda b: k.klinger(b), "force": lambda b: k.force_index(b), "herrick": lambda b: k.herrick(b, b.v + 1)},
    "stops": {"supertrend": lambda b: k.supertrend(b)[0], "supertrend_side": lambda b: k.supertrend(b)[1], "volatility_stop": lambda b: k.volatility_stop(b), "chandelier": lambda b: k.chandelier(b), "chandelier_close": lambda b: k.chandelier(b, close_only=True), "atr_trail": lambda b: k.atr_trail(b), "sar": lambda b: k.parabolic_sar(b), "ha_open": lambda b: k.heikin_ashi(b)[0], "ha_close": lambda b: k.heikin_ashi(b)[3], "smooth_ha_open": lambda b: k.smoothed_heikin_ashi(b)[0], "darvas_top": lambda b: k.darvas(b)[0], "darvas_low": lambda b: k.darvas(b)[1], "jaw": lambda b: k.smma((b.h + b.l) / 2, 13), "teeth": lambda b: k.smma((b.h + b.l) / 2, 8), "lips": lambda b: k.smma((b.h + b.l) / 2, 5)},
    "pivots": {"zigzag": lambda b: k.zigzag(b.c, 10), "peak1": lambda b: k.swing(b.c, 10, 1, True), "trough1": lambda b: k.swing(b.c, 10, 1, False), "peak2_causal": lambda b: k.swing(b.c, 10, 2, True, causal=True), "spaced_breaks": lambda b: k.exrem_span(b.c > k.ref(k.hhv(b.h, 10), -1), 5)},
}

for _name, _steps in RECURRENCES.items():

    @query(f"r_{_name}")
    def _(spark, d, steps=_steps):
        return tidy(scan(bars_eod(spark, d), steps).select("ticker", "ts", *steps))


@query("r_heikin_ashi", f"WITH RECURSIVE {_WALK} SELECT ticker, ts, {r('ho')} AS ha_open, {r('hc')} AS ha_close FROM e")
def _(spark, d):
    return tidy(scan(bars_eod(spark, d), {"ha_open": lambda b: k.heikin_ashi(b)[0], "ha_close": lambda b: k.heikin_ashi(b)[3]}).select("ticker", "ts", "ha_open", "ha_close"))


# -- candles ---------------------------------------------------------------------------------
def _flag(x: str) -> str:
    return f"CAST(coalesce({x}, false) AS BIGINT)"


_CANDLE_STEPS = [
    {f"{x[0]}{i}": lag(x, i) for x in ("open", "high", "low", "close") for i in (1, 2)} | {"hh5": hhv("high", 5), "ll5": llv("low", 5), "m13": ma("close", 13), "ll8": llv("low", 8), "ll2": llv("low", 2), "wb": "close >= open", "bb": "open > close", "gu": f"low > {lag('high')}", "gd": f"high < {lag('low')}"},
    {"wb1": lag("wb"), "bb1": lag("bb"), "m13b": lag("m13", 4), "small": "(open >= close * (1 - 0.0025) AND wb) OR (close >= open * (1 - 0.0025) AND bb)", "large": "(close >= open * (1 + 0.01) AND wb) OR (close <= open * (1 - 0.01) AND bb)"},
    {"ugap": "CASE WHEN bb1 AND wb AND open > o1 THEN 1 WHEN bb1 AND bb AND close > o1 THEN 1 WHEN wb1 AND wb AND open > c1 THEN 1 WHEN wb1 AND bb AND close > c1 THEN 1 ELSE 0 END = 1", "dgap": "CASE WHEN bb1 AND wb AND close < c1 THEN 1 WHEN bb1 AND bb AND open < c1 THEN 1 WHEN wb1 AND wb AND close < o1 THEN 1 WHEN wb1 AND bb AND open < o1 THEN 1 ELSE 0 END = 1",
     "mht": "hh5 = high", "mhy": "hh5 = h1", "mlt": "ll5 = low", "mly": "ll5 = l1"},
]
_LONG = "({}) / (0.001 + high - low)"
_VOCABULARY = {
    "white": "wb", "black": "bb", "small_body": "small", "large_body": "large", "small_upper": "(wb AND high <= close * (1 + 0.0025)) OR (bb AND high <= open * (1 + 0.0025))", "small_lower": "(wb AND low >= open * (1 - 0.0025)) OR (bb AND low >= close * (1 - 0.0025))", "large_upper": "(wb AND high >= close * (1 + 0.01)) OR (bb AND high >= open * (1 + 0.01))",
    "large_lower": "(wb AND low <= open * (1 - 0.01)) OR (bb AND low <= close * (1 - 0.01))", "medium_body": "NOT large AND NOT small", "identical_bodies": "abs(abs(o1 - c1) - abs(open - close)) < abs(open - close) * 0.0025", "body_gap_up": "ugap", "body_gap_down": "dgap", "high_today": "mht", "high_yesterday": "mhy", "low_today": "mlt", "low_yesterday": "mly",
    "doji_today": "abs(close - open) <= close * 0.0025 OR abs(open - close) <= (high - low) * 0.1", "doji_yesterday": "abs(c1 - o1) <= c1 * 0.0025 OR abs(o1 - c1) <= (h1 - l1) * 0.1", "gap_up": "gu", "gap_down": "gd", "big_gap_up": "low > 1.01 * h1", "big_gap_down": "high < 0.99 * l1", "huge_gap_up": "low > 1.02 * h1", "huge_gap_down": "high < 0.98 * l1",
    "double_gap_up": f"gu AND {lag('gu')}", "double_gap_down": f"gd AND {lag('gd')}",
}
_SINGLE = {
    "near_doji": "abs(open - close) <= (high - low) * 0.1", "long_black": f"open > close AND {_LONG.format('open - close')} > 0.6", "small_black": "open > close AND high - low > 3 * (open - close)", "long_white": f"close > open AND {_LONG.format('close - open')} > 0.6", "small_white": "close > open AND high - low > 3 * (close - open)",
    "marubozu_black": "open > close AND high = open AND close = low", "marubozu_white": "close > open AND high = close AND open = low", "closing_marubozu_black": "open > close AND close = low", "closing_marubozu_white": "close > open AND close = high", "opening_marubozu_black": "open > close AND open = high", "opening_marubozu_white": "close > open AND open = low",
    "hanging_man": f"high - low > 4 * (open - close) AND {_LONG.format('close - low')} >= 0.75 AND {_LONG.format('open - low')} >= 0.75", "hammer": f"high - low > 3 * (open - close) AND {_LONG.format('close - low')} > 0.6 AND {_LONG.format('open - low')} > 0.6", "inverted_hammer": f"high - low > 3 * (open - close) AND {_LONG.format('high - close')} > 0.6 AND {_LONG.format('high - open')} > 0.6",
    "shooting_star": f"high - low > 4 * (open - close) AND {_LONG.format('high - close')} >= 0.75 AND {_LONG.format('high - open')} >= 0.75", "spinning_top_black": f"open > close AND high - low > 3 * (open - close) AND {_LONG.format('high - open')} < 0.4 AND {_LONG.format('close - low')} < 0.4", "spinning_top_white": f"close > open AND high - low > 3 * (close - open) AND {_LONG.format('high - close')} < 0.4 AND {_LONG.format('open - low')} < 0.4", "doji": "open = close",
}
_SIMPLE = {
    "bear_abandoned_baby": "c1 = o1 AND c2 > o2 AND open > close AND l1 > h2 AND l1 > high", "evening_doji_star": "c2 > o2 AND (c2 - o2) / (0.001 + h2 - l2) > 0.6 AND c2 < o1 AND c1 > o1 AND h1 - l1 > 3 * (c1 - o1) AND open > close AND open < o1", "dark_cloud": "c1 > o1 * 1.01 AND open > close AND open > h1 AND close > o1 AND (c1 + o1) / 2 > close AND m13 - m13b > 0",
    "bear_engulfing": "c1 > o1 AND open > close AND open >= c1 AND o1 >= close AND open - close > c1 - o1", "three_outside_down": "c2 > o2 AND o1 > c1 AND o1 >= c2 AND o2 >= c1 AND o1 - c1 > c2 - o2 AND open > close AND close < c1", "bull_abandoned_baby": "c1 = o1 AND o2 > c2 AND close > open AND l2 > h1 AND low > h1",
    "morning_doji_star": "o2 > c2 AND (o2 - c2) / (0.001 + h2 - l2) > 0.6 AND c2 > o1 AND o1 > c1 AND h1 - l1 > 3 * (c1 - o1) AND close > open AND open > o1", "bull_engulfing": "o1 > c1 AND close > open AND close >= o1 AND c1 >= open AND close - open > o1 - c1", "three_outside_up": "o2 > c2 AND c1 > o1 AND c1 >= o2 AND c2 >= o1 AND c1 - o1 > o2 - c2 AND close > open AND close > c1",
    "bull_harami": "o1 > c1 AND close > open AND close <= o1 AND c1 <= open AND close - open < o1 - c1", "three_inside_up": "o2 > c2 AND c1 > o1 AND c1 <= o2 AND c2 <= o1 AND c1 - o1 < o2 - c2 AND close > open AND close > c1 AND open > o1", "piercing_line": "c1 < o1 AND (o1 + c1) / 2 < close AND open < close AND open < c1 AND close < o1 AND (close - open) / (0.001 + (high - low)) > 0.6",
    "bear_harami": "c1 > o1 AND open > close AND open <= c1 AND o1 <= close AND open - close < c1 - o1", "three_inside_down": "c2 > o2 AND o1 > c1 AND o1 <= c2 AND o2 <= c1 AND o1 - c1 < c2 - o2 AND open > close AND close < c1 AND open < o1",
    "three_white_soldiers": "close > open * 1.01 AND c1 > o1 * 1.01 AND c2 > o2 * 1.01 AND close > c1 AND c1 > c2 AND open < c1 AND open > o1 AND o1 < c2 AND o1 > o2 AND (high - close) / nullif(high - low, 0) < 0.2 AND (h1 - c1) / nullif(h1 - l1, 0) < 0.2 AND (h2 - c2) / nullif(h2 - l2, 0) < 0.2",
    "three_black_crows": "open > close * 1.01 AND o1 > c1 * 1.01 AND o2 > c2 * 1.01 AND close < c1 AND c1 < c2 AND open > c1 AND open < o1 AND o1 > c2 AND o1 < o2 AND (close - low) / nullif(high - low, 0) < 0.2 AND (c1 - l1) / nullif(h1 - l1, 0) < 0.2 AND (c2 - l2) / nullif(h2 - l2, 0) < 0.2",
    "evening_star": f"{lag('large', 2)} AND {lag('wb', 2)} AND {lag('ugap')} AND NOT {lag('large')} AND bb AND NOT small AND (mht OR mhy)", "morning_star": f"{lag('large', 2)} AND {lag('bb', 2)} AND {lag('dgap')} AND wb AND large AND close > c2 AND mly",
    "matching_low": "ll8 = ll2 AND c1 <= o1 * 0.99 AND abs(close - c1) <= close * 0.0025 AND open > c1 AND open <= high - (high - low) * 0.5",
}
_TWEEZERS = {"tweezer_top": "abs(high - h1) <= high * 0.0025 AND open > close AND c1 > o1 AND (mht OR mhy)", "tweezer_bottom": "(abs(low - l1) / low < 0.0025 OR abs(low - l2) / low < 0.0025) AND open < close AND o1 > c1 AND (mlt OR mly)"}
_ALL_CANDLES = _VOCABULARY | _SINGLE | _SIMPLE | _TWEEZERS


def _first(names: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN p_{n} = 1 THEN '{label}'" for n, label in names.items()) + " ELSE 'Zilch' END"


_LABELS = {
    "candle": _first({"hanging_man": "Hanging Man", "shooting_star": "Shooting Star", "dark_cloud": "Dark Cloud Cover", "bear_engulfing": "Bearish Engulfing", "bear_harami": "Bearish Harami", "evening_star": "Evening Star", "hammer": "Hammer", "inverted_hammer": "Inverted Hammer", "piercing_line": "Piercing Line", "bull_engulfing": "Bullish Engulfing", "bull_harami": "Bullish Harami", "morning_star": "Morning Star", "near_doji": "Near Doji", "doji": "Doji", "matching_low": "MATCHING LOW"}),
    "price_move": _first({"gap_up": "Gap Up", "gap_down": "Gap Down", "big_gap_up": "Big Gap Up", "big_gap_down": "Big Gap Down", "huge_gap_up": "Huge Gap Up", "huge_gap_down": "Huge Gap Down", "double_gap_up": "Double Gap Up", "double_gap_down": "DoubleGapDown"}), "pair": _first({"tweezer_top": "Tweezer Top", "tweezer_bottom": "Tweezer Bottom"}),
}
CANDLE_SQL = staged([*_CANDLE_STEPS, {f"p_{n}": _flag(x) for n, x in _ALL_CANDLES.items()}], KEYS | _LABELS)


@query("k_candles", staged(_CANDLE_STEPS, KEYS | {n: _flag(x) for n, x in (_VOCABULARY | _SINGLE | _SIMPLE).items()}))
def _(spark, d):
    """The candle vocabulary: bodies, shadows, gaps and context, patterns of one bar, simple patterns of two and three."""
    f, flags = candles.scanned_flags(bars_eod(spark, d))
    return out(f, flags)


@query("k_named_candles", CANDLE_SQL)
def _(spark, d):
    """The first candle, price and tweezer label of each bar."""
    f = framed(spark, d)
    return out(f, candles.labels(f))


@query("k_reversals", staged([{f"{x[0]}{i}": lag(x, i) for x in ("high", "low", "close") for i in (1, 2)}], KEYS | {n: _flag(x) for n, x in {
    "closing_price_buy": "low < l1 AND close > c1", "closing_price_sell": "high > h1 AND close < c1", "hook_buy": "open <= low + 0.2 * (high - low) AND close >= high - 0.2 * (high - low) AND low > l1 AND high < h1", "hook_sell": "open >= high - 0.2 * (high - low) AND close <= low + 0.2 * (high - low) AND low > l1 AND high < h1",
    "island_buy": "h1 < l2 AND low > h1", "island_sell": "l1 > h2 AND high < l1", "key_buy": "open < c1 AND low < l1 AND close > h1", "key_sell": "open > c1 AND high > h1 AND close < l1", "open_close_buy": "abs(open - low) <= abs(low) * 0.1 / 100 AND close > h1", "open_close_sell": "abs(open - high) <= abs(high) * 0.1 / 100 AND close < l1",
    "pivot_buy": "l1 < l2 AND low > l1 AND close > h1", "pivot_sell": "h1 > h2 AND high < h1 AND close < l1"}.items()}))
def _(spark, d):
    f = framed(spark, d)
    return out(f, {n: F.coalesce(x, F.lit(False)) for n, x in candles.reversals(f).items()})


@query("k_labels")
def _(spark, d):
    f = framed(spark, d)
    bull, bear, one = candles.bullish(f), candles.bearish(f), candles.single(f)
    return out(f, {"label": candles.first_label(one, "Zilch"), "bullish": candles.all_labels(bull), "bearish": candles.all_labels(bear), **{n: F.coalesce(c, F.lit(False)) for n, c in candles.pin_bar(f).items()}, **candles.base_runs(f)})


@query("k_hit_rates", staged([{"open1": lag("open"), "close1": lag("close"), "later": f"lead(close, 3) {W} - close"}, {"body": "abs(close - open)", "body1": "abs(close1 - open1)"}], {"ticker": "ticker", "pattern": "pattern", "n": "n", "up": "up", "down": "down", "verdict": "CASE WHEN up >= 0.7 * n THEN 'buy' WHEN down >= 0.7 * n THEN 'sell' ELSE '' END"}).replace("FROM s2", "FROM (SELECT ticker, 'bull_engulfing' AS pattern, count(*) AS n, count(*) FILTER (later > 0) AS up, count(*) FILTER (later < 0) AS down FROM s2 WHERE close1 < open1 AND close > open AND open <= close1 AND close >= open1 AND body > body1 GROUP BY ticker)"))
def _(spark, d):
    f = framed(spark, d)
    return tidy(candles.hit_rates(f, {"bull_engulfing": candles.bullish(f)["bull_engulfing"]}))


# -- dimension, flows -----------------------------------------------------------------------------
@query("j_dimension", "SELECT 'S' || s_suppkey AS ticker, s_name AS full_name, n_name AS industry, r_name AS market, s_acctbal AS balance FROM supplier LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON s_nationkey = n_nationkey")
def _(spark, d):
    return dimension(spark, d)


@query("f_flows", "SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS ts, " + ", ".join(f"{r(f'coalesce(sum({c}) FILTER (l_returnflag = {chr(39)}{s}{chr(39)}), 0)', 2)} AS {n}" for s, c, n in (("N", "l_quantity", "buy_qty"), ("R", "l_quantity", "sell_qty"), ("N", "l_extendedprice", "buy_value"), ("R", "l_extendedprice", "sell_value"))) + " FROM lineitem GROUP BY ALL")
def _(spark, d):
    return tidy(flows(spark, d), 2)
