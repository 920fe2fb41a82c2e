"""Swings and what stands on them: nothing changes when later bars come, and the state machines equal plain readings."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import swings as sw
from tickloom.functions.recur import Bars
from tickloom.functions.frame import Frame
from tickloom.operators import setups, swings

SMALL = "/root/testdata/sf0.001"


def walk(n, seed, step=0.03):
    draw = np.random.default_rng(seed)
    close = 50 * np.exp(np.cumsum(draw.normal(0, step, n)))
    spread = np.abs(draw.normal(0, 0.01, (2, n))) * close
    return pd.DataFrame({"ticker": "A", "ts": pd.date_range("2024-01-01", periods=n).date, "open": np.roll(close, 1), "high": close + spread[0], "low": close - spread[1], "close": close, "volume": 100})


def bars_of(frame):
    return Bars(frame)


@pytest.fixture(scope="module")
def frames():
    return {"A": walk(260, 1), "B": walk(200, 2).assign(ticker="B")}


BUILD = {
    "peak_breaks": lambda bars: (lambda f: f.add(**swings.peak_breaks(f)).df)(swings.marked(bars, 2)),
    "trend_lines": lambda bars: (lambda f: f.add(**swings.trend_lines(f)).df)(swings.marked(bars, 6, "h", "l")),
    "rsi_channel": lambda bars: swings.rsi_channel(bars).df,
    "trail_harmonics": lambda bars: swings.trail_harmonics(bars, 0.7, 0.7, 5),
}


@pytest.mark.parametrize("name", BUILD)
def test_later_bars_change_nothing(spark, frames, name):
    """The first 170 bars alone give what they give with all bars behind them."""
    whole = spark.createDataFrame(pd.concat(frames.values()))
    part = spark.createDataFrame(pd.concat(g.head(170) for g in frames.values()))
    last = frames["A"]["ts"][169]
    one, two = BUILD[name](whole).where(F.col("ts") <= F.lit(last)), BUILD[name](part)
    names = [c for c in one.columns if not c.startswith("_h")]
    tidy = lambda df: sorted((tuple(map(str, r)) for r in df.select(names).collect()))
    rows = tidy(one)
    assert rows == tidy(two) and len(rows) > 0


def test_levels_are_known_from_their_bar(spark, frames):
    whole = swings.major_levels(spark.createDataFrame(frames["A"])).collect()
    for cut in (120, 177, 230):
        part = swings.major_levels(spark.createDataFrame(frames["A"].head(cut))).collect()
        assert {(r.side, r.bar, r.price, r.from_bar) for r in part} == {(r.side, r.bar, r.price, r.from_bar) for r in whole if r.from_bar < cut}
        held = sorted((r.side, r.bar) for r in whole if r.from_bar <= cut - 1 and (r.until_bar is None or r.until_bar > cut - 1))
        assert held == sorted((r.side, r.bar) for r in part if r.nth is not None)
    assert max(r.nth for r in whole if r.nth) == 6 and all(r.from_bar > r.bar + 1 for r in whole)


def test_confirmed_swings_by_definition():
    for seed in range(20):
        g = walk(150, seed)
        high, low = g.high.to_numpy(), g.low.to_numpy()
        if seed % 2:
            high[:7] = low[:7] = np.nan
        marks = sw.confirmed(high, low, 5)
        found = [(int(s), int(b), p, i) for i, (s, b, p) in enumerate(marks) if s == s]
        assert len(found) > 5 and all(a[0] == -b[0] for a, b in zip(found, found[1:]))
        for side, bar, price, seen in found:
            if side > 0:
                assert price == high[bar] and low[seen] <= price * 0.95 and (low[bar + 1 : seen] > price * 0.95).all() and (high[bar + 1 : seen] <= price).all()
            else:
                assert price == low[bar] and high[seen] >= price * 1.05 and (high[bar + 1 : seen] < price * 1.05).all() and (low[bar + 1 : seen] >= price).all()
    assert np.isnan(sw.confirmed(np.full(5, np.nan), np.full(5, np.nan), 5)).all() and sw.confirmed(np.zeros(0), np.zeros(0), 5).shape == (0, 3)


def test_segment_lines_are_least_squares():
    g = walk(200, 3)
    x = g.close.to_numpy()
    marks = sw.confirmed(x, x, 4)
    lines, pivots = sw.segment_lines(x, marks), [(i, int(m[1])) for i, m in enumerate(marks) if m[0] == m[0]]
    for (_, p), (seen, q) in zip(pivots, pivots[1:]):
        at = np.arange(p, q + 1)
        slope, level = np.polyfit(at, x[p : q + 1], 1)
        rest = ((x[p : q + 1] - slope * at - level) ** 2).sum()
        want = [p, level + slope * p, slope, math.sqrt(rest / (q - p - 1)) if q - p > 1 else np.nan]
        assert np.allclose(lines[seen], want, equal_nan=True, atol=1e-7)


def test_trail_legs_by_definition():
    b = bars_of(walk(300, 4))
    stop = sw.close_trail(b, 1, 1, 10)
    legs = sw.trail_legs(b, stop)
    side = np.sign(b.c - stop)
    assert np.isnan(stop[0]) and (legs["leg"][1:] == side[1:]).all()
    starts = [i for i in range(2, b.n) if side[i] != side[i - 1]]
    assert [i for i in range(b.n) if legs["side"][i] == legs["side"][i]] == starts and len(starts) > 6
    for first, after in zip(starts, starts[1:]):
        span = slice(first, after)
        x = b.h[span] if side[first] > 0 else -b.l[span]
        at = first + len(x) - 1 - int(np.argmax(x[::-1]))
        assert (legs["side"][after], legs["bar"][after]) == (side[first], at) and legs["price"][after] == abs(x.max())
        assert legs["low_to"][after] == b.l[at : after + 1].min() and legs["high_to"][after] == b.h[at : after + 1].max()


def test_a_planted_pattern_is_found(spark):
    """X 100, A 120, B 108 (0.6 of XA), C 115 (0.58 of AB), D falls through 0.55 of XA and below B: a gartley."""
    points = [130, 100, 120, 108, 115, 104]
    close = np.concatenate([np.linspace(a, b, 12, endpoint=False) for a, b in zip(points, points[1:])] + [[104.0]])
    g = pd.DataFrame({"ticker": "A", "ts": pd.date_range("2024-01-01", periods=len(close)).date, "open": close, "high": close, "low": close, "close": close, "volume": 1})
    rows = swings.trail_harmonics(spark.createDataFrame(g), 1.5, 1.5, 3).orderBy("ts").collect()
    assert rows and {(r.side, r.pattern, r.x, r.a, r.b, r.c) for r in rows} == {(1, "gartley", 100.0, 120.0, 108.0, 115.0)}
    assert all(100 < r.d < 108 for r in rows) and rows[-1].d == 104


def test_cycle_of_a_sine():
    """A steady cycle is found, and the averages over it follow."""
    t = np.arange(400)
    for period in (12, 20, 30):
        x = 100 + 5 * np.sin(2 * np.pi * t / period)
        made = sw.dominant_cycle(x)
        assert abs(made["smooth_period"][-50:].mean() - period) < 0.2 * period
    g = walk(120, 6)
    macd, signal = sw.cycle_macd(bars_of(g))
    assert np.isfinite(macd).all() and np.isnan(signal[:8]).all() and np.allclose(signal[8:], [macd[i - 8 : i + 1].mean() for i in range(8, 120)])
    for n in (0, 1, 5, 7):
        short = bars_of(g.head(n))
        assert len(sw.cycle_macd(short)[0]) == len(sw.phase_average(short)[0]) == n


def test_phase_average_by_a_plain_loop():
    b = bars_of(walk(160, 7))
    x = ((b.h + b.l) / 2).tolist()
    n = len(x)
    s, d, q, i1, ph, m, f = ([0.0] * n for _ in range(7))
    taps = lambda v, i: 0.54 * (0.0962 * v[i] + 0.5769 * v[i - 2] - 0.5769 * v[i - 4] - 0.0962 * v[i - 6])
    for i in range(6, n):
        s[i] = (4 * x[i] + 3 * x[i - 1] + 2 * x[i - 2] + x[i - 3]) / 10
        d[i] = taps(s, i)
        q[i], i1[i] = taps(d, i), d[i - 3]
        ph[i] = 2 * math.pi / math.atan(q[i] / i1[i]) if i1[i] and q[i] else ph[i - 1] if i1[i] else 0.0
        a = max(0.05, 0.5 / max(1.0, ph[i - 1] - ph[i]))
        m[i], f[i] = a * x[i] + (1 - a) * m[i - 1], 0.2 * a * x[i] + (1 - 0.2 * a) * f[i - 1]
    assert np.allclose(sw.phase_average(b), (m, f))


def test_pivot_box_by_definition():
    b = bars_of(walk(150, 8))
    top, low = sw.pivot_box(b)
    from tickloom.functions.recur import heikin_ashi

    _, hh, ll, _ = heikin_ashi(b)
    want, last, value = [], -99, np.nan
    for i in range(b.n):
        if i >= 6 and b.h[i - 2] == b.h[i - 6 : i + 1].max() and i - last > 3:
            last, value = i, hh[i]
        want.append(value)
    assert np.array_equal(top, want, equal_nan=True) and (low[20:] <= hh[20:].max()).all() and (ll.min() <= low[20:]).all()


def test_pin_bars(spark):
    """A falling bar, then one that sticks out below it and closes near its top; and the mirror image."""
    rows = [("A", 1, 10.0, 10.5, 8.0, 8.5), ("A", 2, 8.6, 9.0, 5.0, 8.4), ("B", 1, 8.0, 10.0, 7.5, 9.5), ("B", 2, 9.4, 13.0, 9.0, 9.6), ("C", 1, 10.0, 10.5, 8.0, 8.5), ("C", 2, 6.0, 9.0, 5.0, 8.4)]
    df = spark.createDataFrame(rows, "ticker string, ts int, open double, high double, low double, close double")

    def hits(**options):
        f = Frame(df)
        return sorted((r.ticker, r.bullish_pin, r.bearish_pin) for r in f.add(**setups.pin_bars(f, **options)).df.where("ts = 2").collect())

    assert hits() == [("A", True, False), ("B", False, True), ("C", False, False)]
    assert hits(same_direction=True) == [("A", False, False), ("B", False, False), ("C", False, False)]
    assert hits(inside_body=True) == [("A", False, False), ("B", False, False), ("C", False, False)]
    assert hits(protruding=1.5) == [("A", False, False), ("B", False, False), ("C", False, False)]
    with pytest.raises(ValueError):
        hits(other=1)


def test_trend_pivots_by_a_plain_loop(spark, frames):
    g, n = frames["A"], 12
    high, low = g.high.to_numpy(), g.low.to_numpy()
    since = lambda x, i: int(np.argmax(x[i - n + 1 : i + 1][::-1]))
    down = {i: since(-low, i) < since(high, i) for i in range(n - 1, len(g))}
    want = [(-1, i - 1 - since(-low, i - 1), i) if down[i - 1] else (1, i - 1 - since(high, i - 1), i) for i in range(n, len(g)) if down[i] != down[i - 1]]
    rows = setups.trend_pivots(Frame(spark.createDataFrame(g)), n).orderBy("known_bar").collect()
    assert [(r.side, r.bar, r.known_bar) for r in rows] == want and all(r.price == (high if r.side > 0 else low)[r.bar] for r in rows)
    late = setups.trend_pivots(Frame(spark.createDataFrame(g)), n, 120).collect()
    assert {r.known_bar for r in late} == {i for _, _, i in want if i > len(g) - 1 - 120}
