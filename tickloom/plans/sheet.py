"""The technical sheet: the last bars of liquid shares, with extremes, time frames, MACD events, slopes, volume-price and candle texts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import recur as k
from tickloom.functions.frame import Frame
from tickloom.operators import candles, vpa
from tickloom.operators.scan import scan
from tickloom.operators.timeframes import on_periods
from tickloom.plans import vpa_sql
from tickloom.plans.bars import bars_eod
from tickloom.plans.market_queries import CANDLE_SQL
from tickloom.plans.series_queries import tidy
from tickloom.plans.sqltext import KEYS, W, full, hhv, lag, llv, ma, over, r, staged
from tickloom.plans.walks import DIRECTIONAL, MACD, NUMBERED, RICH, RSI, ema, walk, wilders

QUERIES, SQL = {}, {}
#: Bars of a row in the sheet, bars that the candle texts look back on, and the volume that each of five bars needs.
SHOWN, HELD, LEAST_VOLUME = 15, 40, 5
PERIODS = {5: "1w", 20: "1m", 60: "3m", 120: "6m", 240: "1y", 1200: "5y"}
SLOPES = (20, 50, 150, 250, 1250)


def query(name: str, sql: str):
    def register(make):
        QUERIES[name], SQL[name] = make, sql
        return make

    return register


# -- MACD events ----------------------------------------------------------------------------------------
#: The texts of the twelve events, in the order in which they are joined.
EVENT_TEXTS = {
    "zero_up": "Crossed above zero", "cross_up": " Bullish crossover above zero", "zero_down": " Crossed below Zero", "cross_down": " Bearish crossover above zero", "dip_up": "  Bullish Power Dip", "power_buy": " & Power Buy", "power_short": " & Power Short", "dip_down": " Bearish Power Dip", "hook_up": " & Bullish Hook", "hook_down": " & Bearish Hook",
    "reject_down": " & Bearish zeroline Reject", "reject_up": " & Bullish Zeroline Reject",
}


def crossed(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    b = np.broadcast_to(np.asarray(b, float), a.shape)
    return (a > b) & (k.ref(a, -1) <= k.ref(np.array(b), -1))


def since(hit: np.ndarray) -> np.ndarray:
    at = np.where(hit, np.arange(len(hit)), -1)
    seen = np.maximum.accumulate(at)
    return np.where(seen >= 0, np.arange(len(hit)) - seen, np.nan)


def macd_events(b: k.Bars) -> np.ndarray:
    """The events of a bar as bits, in the order of EVENT_TEXTS."""
    m = k.macd(b.c)
    s = k.ema(m, 9)
    plus, minus, adx = b.once(k.directional)
    up = crossed(m, 0.0)
    down, above, under = crossed(-m, 0.0), crossed(m, s) & (m > 0), crossed(s, m) & (m > 0)
    gap = m - s
    peak, trough = k.ref(gap, -1) == k.hhv(gap, 3), k.ref(gap, -1) == k.llv(gap, 3)
    rising = lambda x: k.ema(x, 3) > k.ref(k.ema(x, 3), -5)
    strong_up, strong_down = (adx > minus) & (plus > minus), (adx > plus) & (minus > plus)
    hits = [
        up, above, down, under, strong_up & rising(adx) & trough & (m > s) & rising(plus), strong_up & (adx > 20) & (plus > 20) & rising(plus) & above, strong_down & (adx > 20) & (minus > 20) & rising(minus) & down,
        strong_down & rising(adx) & peak & (m < s) & rising(minus), (since(under) < 6) & above, (since(above) < 6) & under, (since(up) < 6) & down, (since(down) < 6) & up,
    ]
    return sum(np.where(x, 1 << i, 0) for i, x in enumerate(hits)).astype(float)


def events_text(bits):
    return F.concat(*[F.when(F.col(bits).cast("long").bitwiseAND(F.lit(1 << i)) > 0, text).otherwise("") for i, text in enumerate(EVENT_TEXTS.values())])


def signal_of_averages(b: k.Bars) -> np.ndarray:
    """1 or -1 where MACD crosses its signal with price, RSI and volume on its side; missing otherwise."""
    m, rsi, mean, volume = k.macd(b.c), k.rsi(b.c, 14), k.ma(b.c, 50), k.ma(b.v, 20)
    s = k.ema(m, 9)
    buy, sell = (b.c > mean) & crossed(m, s) & (rsi > 40) & (b.v > volume), (b.c < mean) & crossed(s, m) & (rsi < 60) & (b.v > volume)
    return np.where(buy, 1.0, np.where(sell, -1.0, np.nan))


def _on_lag(x: str, n: int) -> str:
    return f"({x}) {over(n)}"


def _cross(a: str, b: str) -> str:
    return f"coalesce({a} > {b} AND {lag(a)} <= {lag(b) if not b.lstrip('-').isdigit() else b}, false)"


_SMOOTH3 = {f"{x}3": ema(x, 3) for x in ("plus", "minus", "adx")}
_EVENT_STEPS = [
    {"gap": "macd - signal", "j1": _cross("macd", "0"), "j2": f"{_cross('macd', 'signal')} AND macd > 0", "j3": f"{_cross('signal', 'macd')} AND macd > 0", "j4": f"coalesce(macd < 0 AND {lag('macd')} >= 0, false)", **{f"r_{x}": f"{x}3 > {lag(x + '3', 5)}" for x in ("plus", "minus", "adx")}},
    {"tp": f"{lag('gap')} = ({hhv('gap', 3)})", "vl": f"{lag('gap')} = ({llv('gap', 3)})", **{f"a{j}": f"i - max(CASE WHEN {j} THEN i END) OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING)" for j in ("j1", "j2", "j3", "j4")}},
]
_EVENTS = {
    "zero_up": "j1", "cross_up": "j2", "zero_down": "j4", "cross_down": "j3", "dip_up": "adx > minus AND plus > minus AND r_adx AND vl AND macd > signal AND r_plus", "power_buy": "adx > 20 AND plus > 20 AND adx > minus AND plus > minus AND r_plus AND j2", "power_short": "adx > 20 AND minus > 20 AND adx > plus AND minus > plus AND r_minus AND j4",
    "dip_down": "adx > plus AND minus > plus AND r_adx AND tp AND macd < signal AND r_minus", "hook_up": "a3 < 6 AND j2", "hook_down": "a2 < 6 AND j3", "reject_down": "a1 < 6 AND j4", "reject_up": "a4 < 6 AND j1",
}
_EVENTS = {n: x.replace("a1 ", "aj1 ").replace("a2 ", "aj2 ").replace("a3 ", "aj3 ").replace("a4 ", "aj4 ") for n, x in _EVENTS.items()}
_TEXT = " || ".join(f"CASE WHEN {x} THEN '{EVENT_TEXTS[n]}' ELSE '' END" for n, x in _EVENTS.items())
_EVENT_CTES = walk(MACD | DIRECTIONAL | _SMOOTH3 | RSI, RICH, "c")
_EVENT_SQL = staged(_EVENT_STEPS, KEYS | {"macd_event": _TEXT}, source="w", ctes=_EVENT_CTES, recursive=True)


@query("i_macd_texts", f"SELECT * FROM ({_EVENT_SQL}) WHERE macd_event <> ''")
def macd_texts(spark, d):
    """The text of the MACD events of each bar that has one."""
    rows = scan(bars_eod(spark, d), {"bits": macd_events})
    return rows.select("ticker", "ts", events_text("bits").alias("macd_event")).where("macd_event <> ''")


_BUY_SELL = "CASE WHEN coalesce(close > m50 AND macd > signal AND macd1 <= signal1 AND rsi > 40 AND volume > v20, false) THEN 1 WHEN coalesce(close < m50 AND signal > macd AND signal1 <= macd1 AND rsi < 60 AND volume > v20, false) THEN -1 END"
_AVERAGED = {"m50": ma("close", 50), "v20": full("CAST(sum({x}) {w} AS DOUBLE) / 20", "volume", 20), "macd1": lag("macd"), "signal1": lag("signal")}


@query("i_average_signal", staged([_AVERAGED], KEYS | {"buy_sell": f"CAST({_BUY_SELL} AS DOUBLE)"}, source="w", ctes=_EVENT_CTES, recursive=True, tail=f"WHERE ({_BUY_SELL}) IS NOT NULL"))
def average_signals(spark, d):
    return scan(bars_eod(spark, d), {"buy_sell": signal_of_averages}).where("buy_sell is not null").select("ticker", "ts", "buy_sell")


# -- the sheet ---------------------------------------------------------------------------------------------
def slope(x: np.ndarray, n: int) -> np.ndarray:
    """Slope of the least-squares line of the last n values, from running sums of offsets to the first value."""
    i = np.arange(len(x), dtype=float)
    y = x - (x[np.flatnonzero(~np.isnan(x))[0]] if (~np.isnan(x)).any() else 0.0)
    sy, siy = k.total(y, n), k.total(i * y, n)
    mean = i - (n - 1) / 2
    return (siy - mean * sy) / (n * (n * n - 1) / 12)


def correlation(x: np.ndarray, n: int) -> np.ndarray:
    """Correlation of the last n values with their places."""
    return k.div(slope(x, n) * np.sqrt((n * n - 1) / 12), k.roll(x, n, "std"))


def signed_rsi(b: k.Bars, n: int, over_: int) -> np.ndarray:
    rsi = k.rsi(b.c, n)
    return np.where(slope(rsi, over_) >= 0, 1, -1) * rsi


def at_end(x: np.ndarray) -> np.ndarray:
    return np.full(len(x), x[-1] if len(x) else np.nan)


def steps() -> dict[str, Callable[[k.Bars], np.ndarray]]:
    out: dict[str, Callable[[k.Bars], np.ndarray]] = {
        "volume_ma5": lambda b: k.ma(b.v, 5), "rsi_14": lambda b: signed_rsi(b, 14, 14), "previous_close": lambda b: k.ref(b.c, -1), "tsi_12": lambda b: correlation(b.c, 14), "atr_pct_d": lambda b: 100 * k.atr(b, 14) / b.c, "event_bits": macd_events, "buy_sell": signal_of_averages, "avg_spread": vpa.STEPS["avg_spread"],
        "volume_mean": lambda b: k.ma(b.v, 30), "volume_mean_sd": lambda b: k.roll(k.ma(b.v, 30), 30, "std"), "least_volume5": lambda b: k.llv(b.v, 5), "volume_weekly_ma20": lambda b: on_periods(b, "W", lambda p: k.ma(p.v, 20)),
    }
    for n, name in PERIODS.items():
        out |= {f"low_{name}": lambda b, n=n: k.llv(b.l, n), f"close_{name}": lambda b, n=n: k.ref(b.c, -n), f"high_{name}": lambda b, n=n: k.hhv(b.h, n)}
    for n in SLOPES:
        out[f"slope_{n}"] = lambda b, n=n: at_end(np.degrees(np.arctan(slope(b.c, n))))
    for unit in ("W", "M"):
        low = unit.lower()
        out |= {f"rsi_14_{low}": lambda b, u=unit: on_periods(b, u, lambda p: signed_rsi(p, 12, 5)), f"tsi_12_{low}": lambda b, u=unit: on_periods(b, u, lambda p: correlation(p.c, 12)), f"atr_pct_{low}": lambda b, u=unit: on_periods(b, u, lambda p: 100 * k.atr(p, 14) / p.c)}
    return out


def _signed(rsi: str, n: int) -> str:
    return f"CASE WHEN ({full('regr_slope({x}, CAST(i AS DOUBLE)) {w}', rsi, n)}) >= 0 THEN 1 ELSE -1 END * {rsi}"


def _corr(n: int) -> str:
    return full("corr({x}, CAST(i AS DOUBLE)) {w}", "close", n)


def _coarse(unit: str, name: str) -> str:
    """Tables of period bars with the values of the period before, for joining by its start."""
    p = f"p{name}"
    bars = f"{p}bars AS (SELECT ticker, CAST(date_trunc('{unit}', ts) AS DATE) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY ALL)"
    text = walk({"atr": wilders("tr", 14), **RSI}, RICH.split("b AS MATERIALIZED", 1)[0] + "b AS MATERIALIZED" + RICH.split("b AS MATERIALIZED", 1)[1], "c")
    own = text[len(NUMBERED.split(", b AS MATERIALIZED")[0]) + 2 :]  # without the daily bars
    for t in ("b", "c", "e", "w"):
        own = own.replace(f"{t} AS MATERIALIZED", f"{p}{t} AS MATERIALIZED").replace(f"FROM {t} ", f"FROM {p}{t} ").replace(f"FROM {t})", f"FROM {p}{t})").replace(f"JOIN {t} ", f"JOIN {p}{t} ").replace(f"\n{t} AS (", f"\n{p}{t} AS (").replace(f"SELECT {t}.*", f"SELECT {p}{t}.*").replace(f", {t}.", f", {p}{t}.")
    own = own.replace("FROM bars)", f"FROM {p}bars)").replace("i = 15", "i = 13").replace("i > 15", "i > 13").replace(over(14), over(12)).replace("1 / 14.0", "1 / 12.0")
    own = own.replace("(tr) - p_atr) * 1 / 12.0", "(tr) - p_atr) * 1 / 14.0")
    done = f"{p}done AS (SELECT *, {_signed('rsi', 5)} AS srsi, {_corr(12)} AS tsi, 100 * atr / close AS pct, {ma('volume', 20)} AS mv FROM {p}w)"
    return f"{bars}, {own}, {done}, {p} AS (SELECT ticker AS {p}t, ts AS {p}ts, {', '.join(f'lag({x}) {W} AS {x}_{name}' for x in ('srsi', 'tsi', 'pct', 'mv'))} FROM {p}done)"


_DAILY = {
    "v5": ma("volume", 5), "lv5": llv("volume", 5), "srsi": _signed("rsi", 14), "tsi": _corr(14), "pct": "100 * atr / close", "va": full("CAST(sum({x}) {w} AS DOUBLE) / 30", "volume", 30), "s": "high - low", "nth": "row_number() OVER (PARTITION BY ticker ORDER BY ts DESC)", **_AVERAGED,
    "cp": vpa_sql.STEPS[3]["cp"].replace("s *", "(high - low) *"), **{f"lo{n}": llv("low", n) for n in PERIODS}, **{f"cl{n}": lag("close", n) for n in PERIODS}, **{f"hi{n}": hhv("high", n) for n in PERIODS}, **{f"sl{n}": full("regr_slope(close, CAST(i AS DOUBLE)) {w}", "close", n) for n in SLOPES},
}
_LAST = {"vm": full("stddev_pop({x}) {w}", "va", 30), **{f"ang{n}": f"degrees(atan(last_value(sl{n}) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))" for n in SLOPES}}
_SHEET = staged(
    [*_EVENT_STEPS, _DAILY, _LAST],
    {"ticker": "t.ticker", "ts": "t.ts", "volume_ma5": r("v5"), "rsi_14": r("srsi"), "rsi_14_w": r("srsi_w"), "rsi_14_m": r("srsi_m"), "close": r("close"), "previous_close": r("c1"), **{f"{side}_{name}": r(f"{x}{n}") for n, name in PERIODS.items() for side, x in (("low", "lo"), ("close", "cl"), ("high", "hi"))}, "macd_event": _TEXT,
     **{f"slope_{n}": r(f"ang{n}", 2) for n in SLOPES}, **vpa_sql.CLASSES, "candle": "candle", "buy_sell": f"CAST({_BUY_SELL} AS DOUBLE)", "volume": "volume", "volume_weekly_ma20": r("mv_w"), "tsi_12": r("tsi", 3), "tsi_12_w": r("tsi_w", 3), "tsi_12_m": r("tsi_m", 3), "atr_pct_d": r("pct"), "atr_pct_w": r("pct_w"), "atr_pct_m": r("pct_m")},
    source="w", ctes=walk(MACD | DIRECTIONAL | _SMOOTH3 | RSI | {"atr": wilders("tr", 14), "avg_spread": ema("high - low", 40)}, RICH, "c") + ", " + _coarse("week", "w") + ", " + _coarse("month", "m") + f", candles AS ({CANDLE_SQL})", recursive=True,
    tail=f"t LEFT JOIN pw ON pwt = t.ticker AND pwts = date_trunc('week', t.ts) LEFT JOIN pm ON pmt = t.ticker AND pmts = date_trunc('month', t.ts) LEFT JOIN (SELECT ticker AS ct, ts AS cts, candle FROM candles) ON ct = t.ticker AND cts = t.ts WHERE nth <= {SHOWN} AND lv5 >= {LEAST_VOLUME}",
)


@query("e03_technical_sheet", _SHEET)
def technical_sheet(spark, d, least: int = LEAST_VOLUME):
    """The last 15 bars of shares that traded ``least`` on each of five.

    One shuffle brings a share's bars together; what needs long windows or
    recurrences, weeks and months included, is computed in one grouped scan,
    which hands back only the bars that the candle texts look at.
    """
    made = steps()
    f = Frame(scan(bars_eod(spark, d), made, last=HELD))
    s, v, m = F.col("high") - F.col("low"), F.col("volume"), F.col("volume_mean")
    share = lambda x: F.col("close") <= s * x + F.col("low")
    b = {"v": v, "vol_avg": m, "vol_mean": F.col("volume_mean_sd"), "spread": s, "avg_spread": F.col("avg_spread"), "close_pos": F.when(share(0.2), 1).when(share(0.4), 2).when(share(0.6), 3).when(share(0.8), 4).otherwise(5)}
    texts = vpa.texts(b) | {"candle": candles.labels(f)["candle"], "macd_event": events_text("event_bits")}
    nth = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("ts")))
    rows = f.add(nth=nth, **texts).df.where((F.col("nth") <= SHOWN) & (F.col("least_volume5") >= least))
    numbers = [n for n in made if n not in ("event_bits", "avg_spread", "volume_mean", "volume_mean_sd", "least_volume5")]
    return tidy(rows.select("ticker", "ts", "close", "volume", *numbers, *texts), **{f"slope_{n}": 2 for n in SLOPES}, tsi_12=3, tsi_12_w=3, tsi_12_m=3)
