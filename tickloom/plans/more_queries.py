"""Queries of further bands, events, stops, patterns and screens."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickloom.functions import recur as k
from tickloom.functions.frame import Frame
from tickloom.operators import candles, indicators as ind, patterns, timeframes
from tickloom.operators.scan import scan
from tickloom.plans.bars import BARS_SQL, INTRADAY_SQL, bars_eod, bars_intraday
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


MORE = {
    "events": {"macd_event": lambda b: k.macd_events(b.c), "macd_next": lambda b: k.macd_next_change(b.c), "impulse": lambda b: k.impulse(b.c), "regime": lambda b: k.regime(b), "divergence": lambda b: k.divergence(b.c, k.rsi(b.c)), "lows": lambda b: k.successive_lows(k.rsi(b.c)), "t3_prediction": lambda b: k.t3_prediction(b.c), "atr_crossing": lambda b: k.atr_band_crossing(b)},
    "smoothed": {"multiple_cci": lambda b: k.multiple_cci(b), "zero_lag_r": lambda b: k.zero_lag_r(b), "flower": lambda b: k.flower(b), "rsi_top": lambda b: k.adaptive_bands(k.rsi(b.c), 50)[0], "rsi_low": lambda b: k.adaptive_bands(k.rsi(b.c), 50)[1], "projection_70": lambda b: k.rsi_projection(b.c, 14, 70), "volume_explosion": lambda b: k.volume_explosion(b), "bull_volume": lambda b: k.bull_bear_volume(b)[0], "bear_volume": lambda b: k.bull_bear_volume(b)[1]},
    "bands": {"keltner_top": lambda b: k.keltner(b)[0], "keltner_low": lambda b: k.keltner(b)[1], "fib_top1": lambda b: k.fibonacci_bands(b)[0], "fib_low3": lambda b: k.fibonacci_bands(b)[5], "range_top": lambda b: k.range_lines(b)[0], "range_low": lambda b: k.range_lines(b)[1], "stoploss_long": lambda b: k.atr_stoploss(b)[0], "stoploss_short": lambda b: k.atr_stoploss(b)[1], "jnsar": lambda b: k.jnsar(b), "percent_trail": lambda b: k.percent_trail(b.c), "phase_line": lambda b: k.phase_trend(b), "jaw": lambda b: k.ref(k.wilders((b.h + b.l) / 2, 13), -8), "teeth": lambda b: k.ref(k.wilders((b.h + b.l) / 2, 8), -5), "lips": lambda b: k.ref(k.wilders((b.h + b.l) / 2, 5), -3), "asymmetric_stop": lambda b: k.volatility_stop(b, 3.0, 10, bear=2.0)},
    "selected": {n: (lambda b, n=n: k.indicator(n, b, 14)) for n in k.SELECTOR},
}

for _name, _steps in MORE.items():

    @query(f"r_{_name}")
    def _(spark, d, steps=_steps):
        return tidy(scan(bars_eod(spark, d), steps).select("ticker", "ts", *steps))


@query(
    "v_more_levels",
    staged(
        [{"h120": hhv("high", 120), "l120": llv("low", 120), "h13": hhv("high", 13), "l13": llv("low", 13), "nc": "close * 1.01", "rng": ma("high - low", 22), "h22": hhv("high", 22), "c10": ma("close", 10), "c1": lag("close"), "off": "CASE WHEN close < 10 THEN 0.05 WHEN close < 50 THEN 0.1 ELSE 0.002 * close END", "t3": f"greatest({lag('high', 1)}, {lag('high', 2)}, {lag('high', 3)})"}, {"sgn": "coalesce(sign(close - c1), 0) * volume"}],
        KEYS | {"fib_236": r("h120 - 0.236 * (h120 - l120)"), "fib_618": r("h120 - 0.618 * (h120 - l120)"), "predicted_k": r("CASE WHEN h13 IS NOT NULL THEN 100 * (nc - least(l13, nc)) / nullif(greatest(h13, nc) - least(l13, nc), 0) END", 3), "range_stop": r("h22 - 3 * rng", 3), "amp_top": r("close * 1.07"), "three_up": "coalesce(close > t3 + off, false)::BIGINT", "dvi": f"CAST(sum(coalesce(sign(close - c10), 0) * volume) {SO_FAR} AS BIGINT)", "accumulated": r(f"100 * ({total('sgn', 20)}) / nullif(({total('volume', 20)}), 0)"), "td_supply": f"coalesce(high > {lag('high')} AND high > lead(high) {W}, false)::BIGINT"},
    ),
)
def _(spark, d):
    f = framed(spark, d)
    fib = ind.fibonacci_levels(f)
    return out(f, {"fib_236": fib["fib_236"], "fib_618": fib["fib_618"], "predicted_k": ind.predicted_stoch(f), "range_stop": ind.average_range_stop(f), "amp_top": ind.amplitude()["amp_top"], "three_up": ind.three_day_break(f)["three_up"], "dvi": ind.daily_volume(f).cast("long"), "accumulated": ind.accumulation_share(f), "td_supply": ind.td_points(f)["td_supply"]}, predicted_k=3, range_stop=3)


@query("v_states")
def _(spark, d):
    f = Frame(scan(bars_eod(spark, d), {"rsi": lambda b: k.rsi(b.c), "adx": lambda b: k.directional(b)[2], "atr": lambda b: k.atr(b, 14)}))
    return out(f, {"rsi_zone": ind.rsi_zone("rsi"), "trend_strength": ind.trend_strength("adx"), **ind.ribbon(f), "swing_stop": ind.swing_stop(f), **ind.latched_rise(f), **ind.first_bar_trigger(f, "atr", unit="month"), "interest": ind.interest_label(f, "volume"), **ind.targets("close", F.col("close") - 2 * F.col("atr")), **ind.regression_channel(f)})


@query("c_more_breaks", staged([{"hh": hhv("high", 20), "ll": llv("low", 20)}, {"u5": f"coalesce(close > {lag('hh', 5)}, false)", "u": f"coalesce(close > {lag('hh')}, false)", "dn": f"coalesce(close < {lag('ll')}, false)"}, {"g": f"coalesce(sum(dn::INT) OVER ({SPEC} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"}, {"nth": "sum(u::INT) OVER (PARTITION BY ticker, g ORDER BY ts ROWS UNBOUNDED PRECEDING)"}], KEYS | {"shifted_up": "u5::BIGINT", "first_up": "(u AND nth = 1)::BIGINT"}))
def _(spark, d):
    f = framed(spark, d)
    return out(f, {"shifted_up": patterns.shifted_break(f)["shifted_up"], "first_up": patterns.first_breaks(f)["first_up"]})


@query("c_impulses")
def _(spark, d):
    return tidy(patterns.impulses(patterns.pivot_rows(framed(spark, d))))


@query("f_volume_at_price", f"WITH {BARS_SQL}, m AS (SELECT ticker, min(low) AS lo, max(high) AS hi FROM bars GROUP BY ticker) SELECT ticker, CAST(least(29, floor((close - lo) / (hi - lo) * 30)) AS BIGINT) AS bucket, CAST(sum(volume) AS BIGINT) AS volume FROM bars JOIN m USING (ticker) WHERE hi > lo GROUP BY ALL")
def _(spark, d):
    """Volume by 30 equal price bins of each ticker."""
    bars = bars_eod(spark, d)
    ends = bars.groupBy("ticker").agg(F.min("low").alias("lo"), F.max("high").alias("hi")).where("hi > lo")
    bucket = F.least(F.lit(29), F.floor((F.col("close") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 30))
    return bars.join(ends, "ticker").groupBy("ticker", bucket.cast("long").alias("bucket")).agg(F.sum("volume").alias("volume"))


@query("f_session_pace", f"WITH {INTRADAY_SQL.format(width='15 minutes')}, m AS (SELECT *, greatest(0, least(hour(ts) * 60 + minute(ts), 690) - 540) + greatest(0, least(hour(ts) * 60 + minute(ts), 900) - 780) AS minutes FROM intraday) SELECT ticker, ts, minutes, {r('volume * 270 / nullif(minutes, 0)')} AS expected FROM m")
def _(spark, d):
    f = Frame(bars_intraday(spark, d, "15 minutes"))
    return out(f, {"minutes": ind.session_minutes("ts"), "expected": ind.expected_volume("volume", "ts")})


@query("t_mfi_frames")
def _(spark, d):
    """Money flow over days, and over the last completed week and month, and where all are over 50."""
    bars = bars_eod(spark, d)
    f = Frame(bars)
    rows = f.add(mfi_d=ind.mfi(f, 14)).df.select("ticker", "ts", "mfi_d")
    for frame, name in (("W", "mfi_w"), ("M", "mfi_m")):
        c = Frame(timeframes.compress(bars, frame))
        rows = timeframes.expand(rows, c.add(**{name: ind.mfi(c, 6)}).df, frame, [name])
    return tidy(rows.withColumn("all_up", F.coalesce(F.expr("mfi_d > 50 and mfi_w > 50 and mfi_m > 50"), F.lit(False))))


@query("t_sentiment_matrix")
def _(spark, d):
    bars, rows = bars_eod(spark, d), None
    rows = bars.select("ticker", "ts")
    for frame, name in (("W", "sentiment_w"), ("M", "sentiment_m")):
        rows = timeframes.expand(rows, scan(timeframes.compress(bars, frame), {name: lambda b: k.sentimental_rsi(b, 8, 4)}), frame, [name])
    return tidy(rows)


@query("g_parameter_sweep")
def _(spark, d):
    """Close-to-close profit of holding while the short average is above the long one, for each pair of lengths."""
    grid = [(a, b) for a in (5, 10, 20) for b in (30, 50, 100)]

    def steps(a, b):
        return lambda x: np.where(k.ma(x.c, a) > k.ma(x.c, b), k.div(k.ref(x.c, 1), x.c) - 1, 0.0)

    rows = scan(bars_eod(spark, d), {f"s{a}_{b}": steps(a, b) for a, b in grid})
    return tidy(rows.groupBy("ticker").agg(*[F.sum(f"s{a}_{b}").alias(f"profit_{a}_{b}") for a, b in grid]))


@query("z_cointegration")
def _(spark, d):
    """Hedge ratio and unit-root statistic of each ticker against the index."""
    from tickloom.operators.crosssection import with_index
    from tickloom.plans.bars import index_series

    bars = bars_eod(spark, d)

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts")
        ratio, cut, t = k.cointegration(g.close.to_numpy(float), g.index_close.to_numpy(float))
        return pd.DataFrame([(g.ticker.iloc[0], ratio, cut, t)], columns=["ticker", "ratio", "intercept", "t_value"])

    return tidy(with_index(bars, index_series(bars)).select("ticker", "ts", "close", "index_close").groupBy("ticker").applyInPandas(fit, "ticker string, ratio double, intercept double, t_value double"))


@query("e37_signal_labels")
def _(spark, d):
    """Four-way label of each of six smoothed lines: crossed up, above, crossed down, below."""
    pairs = ("rsi", "t3", "williams", "double_ema", "zltema", "t3_rsi")
    f = Frame(scan(bars_eod(spark, d), {f"{n}_{i}": (lambda b, n=n, i=i: b.once(k.signal_lines)[n][i]) for n in pairs for i in (0, 1)}))
    labels = {}
    for n in pairs:
        a, b = F.col(f"{n}_0"), F.col(f"{n}_1")
        labels[f"label_{n}"] = F.when(f.cross(a, b), "buy").when(f.cross(b, a), "sell").when(a > b, "up").when(a < b, "down")
    return out(f, labels)


@query("e31_boom_volume")
def _(spark, d):
    f = framed(spark, d)
    ratio = f.hold(ind.volume_measures(f)["volume_ratio"])
    f.add(ratio=ratio, rank_=f.percent_rank("volume", 50), buy_volume=ind.volume_split()["buy_volume"])
    return tidy(f.df.where("ratio > 2 and close > open").select("ticker", "ts", "close", "ratio", F.col("rank_").alias("volume_rank"), "buy_volume"))


@query("k_more_candles")
def _(spark, d):
    """Windows and tasuki of real bodies, and candles merged over two bars."""
    f = framed(spark, d)
    x, y, z = (candles.Candle(f, n) for n in range(3))
    o2, top, low = y.o, F.greatest(x.h, y.h), F.least(x.l, y.l)
    v = {"rising_window": x.l > y.h, "falling_window": x.h < y.l, "big_body": x.body >= 0.67 * x.span, "long_shadow": (x.upper >= 0.67 * x.span) | (x.lower >= 0.67 * x.span), "gapping_tasuki": (y.l > z.h) & y.white & x.black & (x.c < y.o) & (x.c > z.h), "merged_hammer": (F.least(o2, x.c) - low >= 2 * F.abs(x.c - o2)) & (top - F.greatest(o2, x.c) <= 0.1 * (top - low))}
    return out(f, {n: F.coalesce(c, F.lit(False)) for n, c in v.items()} | {"merged_body": 100 * F.try_divide(x.c - o2, z.c)})


@query(
    "a_ribbons",
    staged([{f"m{n}": ma("close", n) for n in range(10, 81, 10)}], KEYS | {f"ma{n}": r(f"m{n}") for n in range(10, 81, 10)} | {"stacked": "coalesce(" + " AND ".join(f"m{n} > m{n + 10}" for n in range(10, 80, 10)) + ", false)::BIGINT"}),
)
def _(spark, d):
    """Rainbow of averages, and whether they lie in order."""
    f = framed(spark, d)
    m = {n: f.hold(f.ma("close", n)) for n in range(10, 81, 10)}
    stacked = F.lit(True)
    for n in range(10, 80, 10):
        stacked &= m[n] > m[n + 10]
    return out(f, {f"ma{n}": c for n, c in m.items()} | {"stacked": F.coalesce(stacked, F.lit(False))})


@query("a_vegas_tunnel")
def _(spark, d):
    """Exponential stack of 13, 21, 34 and 55 bars against the tunnel of 144 and 169."""
    f = Frame(scan(bars_eod(spark, d), {f"e{n}": (lambda b, n=n: k.ema(b.c, n)) for n in (13, 21, 34, 55, 144, 169)}))
    top, low = F.greatest("e144", "e169"), F.least("e144", "e169")
    return out(f, {"stack_up": F.expr("e13 > e21 and e21 > e34 and e34 > e55"), "above_tunnel": F.col("close") > top, "below_tunnel": F.col("close") < low, "tunnel_up": f.cross("close", f.hold(top)), "tunnel_down": f.cross(f.hold(low), "close")})


@query("i_directional_signals")
def _(spark, d):
    """Three ways to trade directional movement: crossing, crossing in a trend, and a turn of ADX; repeats within 5 bars are silent."""
    steps = {"plus": lambda b: k.directional(b)[0], "minus": lambda b: k.directional(b)[1], "adx": lambda b: k.directional(b)[2], "spaced": lambda b: k.exrem_span((k.directional(b)[0] > k.directional(b)[1]) & (k.ref(k.directional(b)[0], -1) <= k.ref(k.directional(b)[1], -1)), 5)}
    f = Frame(scan(bars_eod(spark, d), steps))
    up = f.hold(f.cross("plus", "minus"))
    return out(f, {"di_cross": up, "di_trend": up & (F.col("adx") > 25), "adx_turn": (F.col("adx") > f.ref("adx", -1)) & (f.ref("adx", -1) <= f.ref("adx", -2)), "spaced": F.col("spaced")})


@query("i_stoch_signals")
def _(spark, d):
    f = Frame(scan(bars_eod(spark, d), {"k14": lambda b: k.stoch_k(b), "d14": lambda b: k.stoch_d(b)}))
    return out(f, {"oversold_up": f.cross("k14", "d14") & (F.col("k14") < 20), "overbought_down": f.cross("d14", "k14") & (F.col("k14") > 80)})


@query("r_fractal_breakouts")
def _(spark, d):
    """Close above the last confirmed fractal top (five bars old at least), out on a five-bar low; held state."""
    f = framed(spark, d)
    marks = {n: f.hold(c) for n, c in patterns.fractals(f).items()}
    top = f.hold(f.ref(f.hold(f.value_when(marks["top"], "high")), -5))
    buy, sell = f.hold(f.cross("close", top)), f.hold(F.coalesce(F.col("close") < f.ref(f.hold(f.llv("low", 5)), -1), F.lit(False)))
    return out(f, {"level": top, "buy": buy, "sell": sell, "held": f.flip(buy, sell)})


@query("r_simple_trails", staged([{"h5": hhv("high", 5), "l5": llv("low", 5), "h22": hhv("high", 22), "h3": hhv("high", 3), "l3": llv("low", 3)}, {"h5b": lag("h5"), "l5b": lag("l5"), "h3b": lag("h3"), "l3b": lag("l3")}], KEYS | {"fast_state": "CASE WHEN close > h3b THEN 1 WHEN close < l3b THEN -1 ELSE 0 END", "slow_state": "CASE WHEN close > h5b THEN 1 WHEN close < l5b THEN -1 ELSE 0 END", "under_high": r("100 * (h22 - close) / h22")}))
def _(spark, d):
    """Two trailing ranges and the distance under the 22-bar high."""
    f = framed(spark, d)

    def state(n):
        top, low = f.hold(f.ref(f.hold(f.hhv("high", n)), -1)), f.hold(f.ref(f.hold(f.llv("low", n)), -1))
        return F.when(F.col("close") > top, 1).when(F.col("close") < low, -1).otherwise(0)

    h = f.hold(f.hhv("high", 22))
    return out(f, {"fast_state": state(3), "slow_state": state(5), "under_high": 100 * (h - F.col("close")) / h})


@query("x_index_overlay")
def _(spark, d):
    """State of the index against its weighted means, on every ticker's bars."""
    from tickloom.operators.crosssection import with_index
    from tickloom.plans.bars import index_series

    bars = bars_eod(spark, d)
    ix = index_series(bars)
    f = Frame(ix.withColumn("ticker", F.lit("INDEX")).withColumnRenamed("index_close", "close"))
    a, b, c = (f.hold(f.wma("close", n)) for n in (15, 50, 200))
    state = F.when((a > b) & (b > c), "bull").when((a < b) & (b < c), "bear").otherwise("mixed")
    return with_index(bars.select("ticker", "ts", "close"), f.add(index_state=state).df.select("ts", "index_state")).transform(tidy)


@query("c_extreme_summary", staged([{f"h{n}": hhv("high", n) for n in (20, 50, 100)} | {f"l{n}": llv("low", n) for n in (20, 50, 100)}], KEYS | {f"at_high_{n}": f"coalesce(high = h{n}, false)::BIGINT" for n in (20, 50, 100)} | {f"at_low_{n}": f"coalesce(low = l{n}, false)::BIGINT" for n in (20, 50, 100)}))
def _(spark, d):
    f = framed(spark, d)
    flags = {f"at_high_{n}": F.coalesce(F.col("high") == f.hhv("high", n), F.lit(False)) for n in (20, 50, 100)}
    return out(f, flags | {f"at_low_{n}": F.coalesce(F.col("low") == f.llv("low", n), F.lit(False)) for n in (20, 50, 100)})


@query("e29_average_strategies")
def _(spark, d):
    """Three entries: TEMA crossing, EMA with breakout and volume, and the 3 over 20 bar means."""
    f = Frame(scan(bars_eod(spark, d), {"t9": lambda b: k.tema(b.c, 9), "t20": lambda b: k.tema(b.c, 20), "e20": lambda b: k.ema(b.c, 20)}))
    top, mv = f.hold(f.ref(f.hold(f.hhv("high", 20)), -1)), f.hold(f.ma("volume", 20))
    m3, m20 = f.hold(f.ma("close", 3)), f.hold(f.ma("close", 20))
    f.add(tema_entry=f.cross("t9", "t20"), break_entry=F.coalesce((F.col("close") > F.col("e20")) & (F.col("close") > top) & (F.col("volume") > mv), F.lit(False)), mean_entry=f.cross(m3, m20))
    return tidy(f.df.where("tema_entry or break_entry or mean_entry").select("ticker", "ts", "close", "tema_entry", "break_entry", "mean_entry"))


@query("e30_intraday_systems")
def _(spark, d):
    """On 15-minute bars: break of the prior hour's range, pull-back to a rising mean, MACD and stochastic crossings."""
    bars = timeframes.price_of(timeframes.price_of(bars_intraday(spark, d, "15 minutes"), "high", "1 hour", -1, "hour_high"), "low", "1 hour", -1, "hour_low")
    f = Frame(scan(bars, {"macd": lambda b: k.macd(b.c), "signal": lambda b: k.macd_signal(b.c), "k14": lambda b: k.stoch_k(b), "d14": lambda b: k.stoch_d(b)}))
    m = f.hold(f.ma("close", 20))
    return out(f, {"hour_break": F.coalesce(F.col("close") > F.col("hour_high"), F.lit(False)), "hour_fall": F.coalesce(F.col("close") < F.col("hour_low"), F.lit(False)), "pull_back": F.coalesce((F.col("low") <= m) & (F.col("close") > m) & (m > f.ref(m, -1)), F.lit(False)), "macd_up": f.cross("macd", "signal"), "stoch_up": f.cross("k14", "d14")})


@query("e32_pattern_scanner")
def _(spark, d):
    """Last bar of each ticker with its candle patterns, cloud state and divergence."""
    f = Frame(scan(bars_eod(spark, d), {"divergence": lambda b: k.divergence(b.c, k.rsi(b.c))}))
    cloud = ind.ichimoku_signals(f)
    f.add(bull=candles.all_labels(candles.bullish(f)), bear=candles.all_labels(candles.bearish(f)), cloud=cloud["cloud"], grade=cloud["tk_grade"])
    from tickloom.plans.screens import last_bars

    return tidy(last_bars(f).select("ticker", "ts", "close", "bull", "bear", "cloud", "grade", "divergence"))


@query("k_strict", staged([{"o1": lag("open"), "c1": lag("close"), "h1": lag("high"), "l1": lag("low")}], KEYS | {"engulfing_strict": "coalesce((c1 < o1 AND close > open AND open < c1 AND close > o1) OR (c1 > o1 AND close < open AND open > c1 AND close < o1), false)::BIGINT", "outside_bar": "coalesce(high > h1 AND low < l1, false)::BIGINT", "inside_bar": "coalesce(high < h1 AND low > l1, false)::BIGINT", "doji_strict": "coalesce(abs(close - open) <= 0.05 * (high - low), false)::BIGINT"}))
def _(spark, d):
    f = framed(spark, d)
    x, y = candles.Candle(f, 0), candles.Candle(f, 1)
    v = {"engulfing_strict": (y.black & x.white & (x.o < y.c) & (x.c > y.o)) | (y.white & x.black & (x.o > y.c) & (x.c < y.o)), "outside_bar": (x.h > y.h) & (x.l < y.l), "inside_bar": (x.h < y.h) & (x.l > y.l), "doji_strict": x.doji}
    return out(f, {n: F.coalesce(c, F.lit(False)) for n, c in v.items()})
