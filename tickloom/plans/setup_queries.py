"""Queries of set-ups, double extremes within a share of the true range, and the smoothed breadth thrust."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import recur as k
from tickloom.functions.frame import Frame
from tickloom.operators import crosssection, indicators as ind, patterns, setups, timeframes
from tickloom.operators.scan import scan
from tickloom.plans import walks
from tickloom.plans.bars import BARS_SQL, bars_eod
from tickloom.plans.further import _DATES
from tickloom.plans.recurrence_sql import _SPACED, _mfi_sql, compressed, layered
from tickloom.plans.screens import _PIVOT_ROWS
from tickloom.plans.series_queries import framed, out, tidy
from tickloom.plans.sqltext import KEYS, W, div, hhv, lag, llv, ma, over, r, staged

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(make):
        QUERIES[name] = make
        if sql:
            SQL[name] = sql
        return make

    return register


_PARTS = {"o1": lag("open"), "h1": lag("high"), "l1": lag("low"), "c1": lag("close")}
_SIZES = {
    "nose": "CASE WHEN high = low THEN 0.1 ELSE high - low END", "eye": "CASE WHEN h1 = l1 THEN 0.1 ELSE h1 - l1 END", "body": "CASE WHEN open = close THEN 0.1 ELSE abs(open - close) END", "eb": "CASE WHEN o1 = c1 THEN 0.1 ELSE abs(o1 - c1) END",
    "top": "greatest(open, close)", "bot": "least(open, close)",
}
_SHAPE = "body / nose <= 0.33 AND eb / eye >= 0.1 AND body / eb <= 1 AND top <= h1 AND bot >= l1"


@query(
    "k_pin_bars",
    staged(
        [_PARTS, _SIZES],
        KEYS
        | {"bullish_pin": f"coalesce({_SHAPE} AND l1 - low >= nose * 0.5 AND 1 - (bot - low) / nose < 0.4 AND h1 - high >= eye * 0.2 AND c1 < o1, false)::BIGINT"}
        | {"bearish_pin": f"coalesce({_SHAPE} AND high - h1 >= nose * 0.5 AND 1 - (high - top) / nose < 0.4 AND low - l1 >= eye * 0.2 AND c1 > o1, false)::BIGINT"}
        | {"strict_bullish": f"coalesce({_SHAPE} AND l1 - low >= nose * 0.2 AND 1 - (bot - low) / nose < 0.4 AND h1 - high >= eye * 0.2 AND close > open, false)::BIGINT"},
    ),
)
def _(spark, d):
    """Pin bars with the published bounds; and such that rise themselves, after any bar, and stick out less."""
    f = framed(spark, d)
    return out(f, setups.pin_bars(f) | {"strict_bullish": setups.pin_bars(f, opposite_eye=False, same_direction=True, protruding=0.2)["bullish_pin"]})


_AGE = {f"{x}_age": f"i - arg_max(i, row({s}{c}, i)) {over(12)}" for x, c, s in (("high", "high", ""), ("low", "low", "-"))}
_TREND = f"""WITH {BARS_SQL}, b AS (SELECT *, row_number() {W} - 1 AS i FROM bars), a AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _AGE.items())} FROM b),
s AS (SELECT *, CASE WHEN i >= 11 THEN low_age < high_age END AS down, max(i) OVER (PARTITION BY ticker) AS last FROM a),
p AS (SELECT *, {lag('down')} AS was, {lag('low_age')} AS low_was, {lag('high_age')} AS high_was FROM s),
f AS (SELECT ticker, ts, CASE WHEN was THEN -1 ELSE 1 END AS side, i - 1 - CASE WHEN was THEN low_was ELSE high_was END AS bar, i AS known_bar FROM p WHERE was IS NOT NULL AND down <> was AND i > last - 120)"""


@query("c_trend_pivots", f"{_TREND} SELECT f.ticker, f.ts, f.side, f.bar, f.known_bar, {r('CASE WHEN f.side > 0 THEN b.high ELSE b.low END')} AS price, row_number() OVER (PARTITION BY f.ticker, f.side ORDER BY f.known_bar DESC) AS nth FROM f JOIN b ON b.ticker = f.ticker AND b.i = f.bar")
def _(spark, d):
    """Pivots of the trend that are known on a ticker's last 120 bars."""
    return tidy(setups.trend_pivots(framed(spark, d), 12, 120))


_ATR = f"{walks.walk({'atr': walks.wilders('tr', 20)})}, a AS (SELECT ticker, i - 1 AS bar, {lag('atr')} AS atr1 FROM w)"


@query(
    "c_double_extremes",
    f"WITH RECURSIVE {_ATR}, {_PIVOT_ROWS.removeprefix('WITH ')} SELECT ticker, ts, bar, CASE WHEN side = 1 THEN 'double top' ELSE 'double bottom' END AS pattern, {r('price')} AS price FROM (SELECT *, lag(price) OVER (PARTITION BY ticker, side ORDER BY bar) AS b FROM pv) JOIN a USING (ticker, bar) WHERE abs(price - b) < 0.75 * atr1",
)
def _(spark, d):
    """Tops and bottoms within 0.75 mean true ranges of the last of their side."""
    f = Frame(scan(bars_eod(spark, d), {"atr": lambda b: k.atr(b, 20)}))
    f.add(atr1=f.ref("atr", -1))
    return tidy(patterns.double_extremes(patterns.pivot_rows(f, keep=("atr1",)), 0.75 * F.col("atr1")))


@query("x_breadth_thrust", f"WITH RECURSIVE {walks.walk({'thrust': walks.ema('share / 100', 10)}, ctes=_DATES, source='sh')} SELECT ts, {r('thrust')} AS thrust FROM w")
def _(spark, d):
    """Share of advancing among moving issues, smoothed over ten dates: one row a date, smoothed in one pass over the calendar."""
    share = crosssection.stix(crosssection.breadth(bars_eod(spark, d)))
    bars = share.withColumns({c: F.col("close") for c in ("open", "high", "low")} | {"volume": F.lit(0)})
    return tidy(scan(bars, {"thrust": lambda b: k.ema(b.c / 100, 10)}).select("ts", "thrust"))


def _spaced_sql(steps: list[dict[str, str]], value: str, n: int) -> str:
    """SQL of ``value`` and of the signals buy_ and sell_, each silent for n bars after one that passed."""
    base = staged([{"i": f"row_number() {W}"}, *steps], {"ticker": "ticker", "ts": "ts", "i": "i", "value": value, "b": "coalesce(buy_, false)", "s": "coalesce(sell_, false)"})
    return f"WITH RECURSIVE x AS MATERIALIZED ({base}), {_SPACED.format(into='pb', hit='b', source='x', n=n)}, {_SPACED.format(into='ps', hit='s', source='x', n=n)}"


_FAR = [{"m50": ma("close", 50), "c20": lag("close", 20)}, {"away": f"100 * {div('close - m50', 'm50')}"}, {"lo": llv("away", 200), "hi": hhv("away", 200), "moved": "abs(100 * (close / nullif(c20, 0) - 1)) > 15"}, {"buy_": "away <= lo AND away < -10 AND moved", "sell_": "away >= hi AND away > 10 AND moved"}]


@query("a_far_from_average", f"{_spaced_sql(_FAR, 'away', 20)} SELECT x.ticker, x.ts, {r('x.value')} AS away, CAST(pb.pass AS DOUBLE) AS buy, CAST(ps.pass AS DOUBLE) AS sell FROM x JOIN pb USING (ticker, i) JOIN ps USING (ticker, i)")
def _(spark, d):
    """Distance from the 50-bar mean, and where it is the farthest of 200 bars after a large move."""
    return tidy(scan(bars_eod(spark, d).select("ticker", "ts", "close"), setups.far_steps(), keep=("ticker", "ts")))


_J = [{"l9": llv("low", 9), "h9": hhv("high", 9)}, {"raw": f"100 * {div('close - l9', 'h9 - l9')}"}, {"kk": ma("raw", 3)}, {"dd": ma("kk", 3)}, {"j": "3 * kk - 2 * dd"}, {"j1": lag("j"), "j2": lag("j", 2)}, {"buy_": "j > j1 AND j2 > j1 AND j1 < 0", "sell_": "j < j1 AND j2 < j1 AND j1 > 100"}]


@query("i_j_turns", f"{_spaced_sql(_J, 'j', 5)} SELECT x.ticker, x.ts, {r('x.value', 3)} AS j, CAST(pb.pass AS DOUBLE) AS buy, CAST(ps.pass AS DOUBLE) AS sell FROM x JOIN pb USING (ticker, i) JOIN ps USING (ticker, i)")
def _(spark, d):
    """The J line and its turns from beyond 0 and 100; repeats within five bars are silent."""
    f = framed(spark, d)
    made = setups.j_turns(f)
    f.given.append("j")
    f.add(j=made.pop("j"))
    return tidy(setups.spaced(f, made, 5).select("ticker", "ts", "j", "buy", "sell"), 3)


@query(
    "v_keltner_bands",
    layered([{"e20": walks.ema("close", 20), "a10": walks.wilders("tr", 10)}], KEYS | {"center": r("e20")} | {f"{n}{k}": r(f"e20 {s} {k} * a10") for k in (1, 2, 3) for n, s in (("top", "+"), ("low", "-"))}),
)
def _(spark, d):
    """Three bands about the exponential mean."""
    steps = setups.keltner_steps()
    return tidy(scan(bars_eod(spark, d), steps).select("ticker", "ts", *steps))


# -- money flow of day, week and month with volume that grows in two of them --------------------
_WEEK_VOLUME = "(volume > 1.2 * v10 AND v1 > 1.2 * v10b) OR (volume > 1.2 * v1 AND v1 > 1.2 * v2) OR (v1 > 1.2 * v2 AND v2 > 1.2 * v3)"
_MONTH_VOLUME = "(volume > 1.3 * v5 AND v1 > 1.3 * v5b) OR volume > 1.3 * v1 OR (v1 > 1.3 * v2 AND volume < v1) OR (v2 > 1.3 * v3 AND v1 < v2 AND volume < v2)"
#: Mean close times mean volume of ten bars that a share must pass; the published 50,000 fits another market's prices.
LEAST_TRADED = 20_000


def _period_sql(unit: str, source: str, n: int, rule: str) -> str:
    lags = ", ".join(f"lag(volume, {k}) {W} AS v{k}" for k in (1, 2, 3))
    return f"""{_mfi_sql(source, 7, f'{source}_mfi')}, {source}_v AS (SELECT *, {lags}, {ma('volume', n)} AS v{n} FROM {source}), {source}_w AS (SELECT *, {lag(f'v{n}')} AS v{n}b FROM {source}_v),
{source}_p AS (SELECT x.ticker, x.ts, m.mfi, coalesce({rule}, false) AS loud FROM {source}_w x JOIN {source}_mfi m USING (ticker, ts)),
{source}_q AS (SELECT ticker, ts, lag(mfi) {W} AS mfi, lag(mfi, 2) {W} AS mfi1, lag(loud) {W} AS loud FROM {source}_p)"""


_MFI_SCREEN = f"""WITH RECURSIVE {compressed('month', 'months', compressed('week', 'weeks', walks.walk({'f': walks.ema('close', 6), 's': walks.ema('close', 13), 'm': ('f - s', '1'), 'sig': walks.ema('m', 5)})))},
{_mfi_sql('bars', 14, 'days_mfi')}, {_period_sql('week', 'weeks', 10, _WEEK_VOLUME)}, {_period_sql('month', 'months', 5, _MONTH_VOLUME)},
j AS (SELECT w.ticker, w.ts, w.close, w.volume, d.mfi AS mfi_d, wq.mfi AS mfi_w, wq.mfi1 AS mfi_w1, mq.mfi AS mfi_m, wq.loud AS loud_w, mq.loud AS loud_m, w.m, w.sig FROM w JOIN days_mfi d USING (ticker, ts)
 LEFT JOIN weeks_q wq ON wq.ticker = w.ticker AND wq.ts = CAST(date_trunc('week', w.ts) AS DATE) LEFT JOIN months_q mq ON mq.ticker = w.ticker AND mq.ts = CAST(date_trunc('month', w.ts) AS DATE)),
k AS (SELECT *, {ma('volume', 20)} AS v20, {lag('volume')} AS vb, {ma('close', 10)} AS c10, {ma('volume', 10)} AS v10, mfi_d > mfi_w1 AND {lag('mfi_d')} <= {lag('mfi_w1')} AS crossed, m > sig AND {lag('m')} <= {lag('sig')} AS macd_up FROM j)
SELECT ticker, ts, {r('close')} AS close, {r('mfi_d')} AS mfi_d, {r('mfi_w')} AS mfi_w, {r('mfi_m')} AS mfi_m FROM k
WHERE ((crossed AND mfi_m > 40 AND mfi_w > 60) OR (mfi_m > 50 AND mfi_w > 50 AND macd_up)) AND volume > 1.3 * v20 AND volume > vb AND (loud_w OR loud_m) AND c10 * v10 > {LEAST_TRADED}"""


@query("t_mfi_cross_screen", _MFI_SCREEN)
def _(spark, d):
    return tidy(mfi_cross_screen(bars_eod(spark, d)))


def mfi_cross_screen(bars, least: float = LEAST_TRADED):
    """Bars whose money flow crosses the week's while week and month are strong, or whose MACD turns up then, on volume that grows by day and by week or month.

    Weeks and months are the last completed ones.
    """
    f = Frame(scan(bars, {"m": lambda b: k.macd(b.c, 6, 13), "sig": lambda b: k.macd_signal(b.c, 6, 13, 5)}))
    rows = f.add(mfi_d=ind.mfi(f, 14)).df.select("ticker", "ts", "close", "volume", "m", "sig", "mfi_d")
    for frame, tag, n in (("W", "w", 10), ("M", "m", 5)):
        c = Frame(timeframes.compress(bars, frame))
        v = F.col("volume")
        mean = c.hold(c.ma("volume", n))
        one, two, three, before = (c.hold(x) for x in (c.ref("volume", -1), c.ref("volume", -2), c.ref("volume", -3), c.ref(mean, -1)))
        if frame == "W":
            loud = ((v > 1.2 * mean) & (one > 1.2 * before)) | ((v > 1.2 * one) & (one > 1.2 * two)) | ((one > 1.2 * two) & (two > 1.2 * three))
        else:
            loud = ((v > 1.3 * mean) & (one > 1.3 * before)) | (v > 1.3 * one) | ((one > 1.3 * two) & (v < one)) | ((two > 1.3 * three) & (one < two) & (v < two))
        flow = c.hold(ind.mfi(c, 7))
        coarse = c.add(**{f"mfi_{tag}": flow, f"mfi_{tag}1": c.ref(flow, -1), f"loud_{tag}": F.coalesce(loud, F.lit(False))}).df
        rows = timeframes.expand(rows, coarse, frame, [f"mfi_{tag}", f"mfi_{tag}1", f"loud_{tag}"])
    g = Frame(rows)
    m = g.hold_all({"v20": g.ma("volume", 20), "vb": g.ref("volume", -1), "c10": g.ma("close", 10), "v10": g.ma("volume", 10), "crossed": g.cross("mfi_d", "mfi_w1"), "macd_up": g.cross("m", "sig")})
    strong = (m["crossed"] & (F.col("mfi_m") > 40) & (F.col("mfi_w") > 60)) | ((F.col("mfi_m") > 50) & (F.col("mfi_w") > 50) & m["macd_up"])
    loud = (F.col("volume") > 1.3 * m["v20"]) & (F.col("volume") > m["vb"]) & (F.col("loud_w") | F.col("loud_m"))
    return g.df.where(strong & loud & (m["c10"] * m["v10"] > least)).select("ticker", "ts", "close", "mfi_d", "mfi_w", "mfi_m")
