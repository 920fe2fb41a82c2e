"""Bar-series primitives on small frames with known results, and the look-ahead property."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import recur as k
from tickloom.functions.frame import Frame
from tickloom.operators import candles, crosssection, patterns, timeframes, trades, vpa
from tickloom.operators import indicators as ind
from tickloom.operators.scan import scan


def bars(spark, closes, ticker="A", volume=None, start=datetime.date(2024, 1, 1)):
    rows = [(ticker, start + datetime.timedelta(days=i), c, None if c is None else c + 1.0, None if c is None else c - 1.0, c, (volume or [10] * len(closes))[i]) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, ts date, open double, high double, low double, close double, volume long")


def column(f, c):
    return [r[0] for r in f.add(x=c).df.orderBy("ts").select("x").collect()]


def test_windows_are_null_until_full(spark):
    f = Frame(bars(spark, [1.0, 2.0, 3.0, 4.0]))
    assert column(f, f.ma("close", 3)) == [None, None, 2.0, 3.0]
    assert column(f, f.hhv("close", 2)) == [None, 2.0, 3.0, 4.0]
    assert column(f, f.wma("close", 2)) == [None, 5 / 3, 8 / 3, 11 / 3]


def test_short_series_and_nulls(spark):
    f = Frame(bars(spark, [1.0, None, 3.0]))
    assert column(f, f.ma("close", 2)) == [None, None, None]
    assert column(f, f.bar()) == [0, 1, 2]
    one = Frame(bars(spark, [5.0]))
    assert column(one, one.roc("close", 1)) == [None]


def test_constant_price_has_null_ratios(spark):
    f = Frame(bars(spark, [2.0] * 20).withColumn("high", F.lit(2.0)).withColumn("low", F.lit(2.0)))
    assert set(column(f, ind.williams_r(f, 5))) == {None}


def test_exrem_flip_and_spans(spark):
    df = bars(spark, [1.0] * 7).withColumn("a", F.col("ts").cast("string").isin("2024-01-01", "2024-01-02", "2024-01-04", "2024-01-05")).withColumn("b", F.col("ts").cast("string").isin("2024-01-03", "2024-01-05"))
    f = Frame(df)
    assert column(f, f.exrem("a", "b")) == [True, False, False, True, False, False, False]
    assert column(f, f.flip("a", "b")) == [True, True, False, True, True, True, True]
    assert k.exrem_span(np.array([1, 1, 0, 1, 1], bool), 2).tolist() == [True, False, False, True, False]


def test_value_when_and_since(spark):
    f = Frame(bars(spark, [1.0, 5.0, 2.0, 6.0, 3.0]))
    hit = F.col("close") > 4
    assert column(f, f.value_when(hit, "close", 1)) == [None, 5.0, 5.0, 6.0, 6.0]
    assert column(f, f.value_when(hit, "close", 2)) == [None, None, None, 5.0, 5.0]
    assert column(f, f.value_when(hit, "close", 0)) == [5.0, 6.0, 6.0, None, None]
    assert column(f, f.since(hit, "close", top=False)) == [None, 5.0, 2.0, 6.0, 3.0]


CAUSAL = {"ma": lambda f: f.ma("close", 3), "hhv": lambda f: f.hhv("high", 3), "cci": lambda f: ind.cci(f, 5), "mfi": lambda f: ind.mfi(f, 5), "obv": ind.obv, "slope": lambda f: f.slope("close", 5), "ultimate": lambda f: ind.ultimate(f, 2, 3, 4)}
AHEAD = {"future": lambda f: f.future("high", 3), "ref": lambda f: f.ref("close", 2), "last": lambda f: f.last_value("close")}


@pytest.mark.parametrize("name", [*CAUSAL, *AHEAD])
def test_look_ahead(spark, name):
    """Removing later rows changes what looks ahead, and nothing else."""
    rng = np.random.default_rng(3)
    closes = (100 + rng.normal(size=40).cumsum()).tolist()
    make = (CAUSAL | AHEAD)[name]
    whole, cut = Frame(bars(spark, closes)), Frame(bars(spark, closes[:30]))
    same = column(whole, make(whole))[:30] == column(cut, make(cut))
    assert same == (name in CAUSAL)


def plain_ema(x, n):
    out, y = [], None
    for v in x:
        y = v if y is None else v * 2 / (n + 1) + (1 - 2 / (n + 1)) * y
        out.append(y)
    return out


def plain_rsi(x, n):
    out, up, down = [None] * len(x), 0.0, 0.0
    for i in range(1, len(x)):
        u, d = max(x[i] - x[i - 1], 0), max(x[i - 1] - x[i], 0)
        up, down = (up + u / n, down + d / n) if i <= n else (up + (u - up) / n, down + (d - down) / n)
        if i >= n:
            out[i] = 100 * up / (up + down)
    return out


def test_recurrences_against_plain_loops(spark):
    rng = np.random.default_rng(1)
    x = (50 + rng.normal(size=200).cumsum()).tolist()
    df = scan(bars(spark, x), {"ema": lambda b: k.ema(b.c, 9), "rsi": lambda b: k.rsi(b.c, 14), "k": lambda b: k.stoch_k(b), "adx": lambda b: k.directional(b)[2]}).orderBy("ts").toPandas()
    assert np.allclose(df.ema, plain_ema(x, 9))
    assert np.allclose(df.rsi.astype(float), np.array(plain_rsi(x, 14), float), equal_nan=True)
    assert df.rsi.dropna().between(0, 100).all() and df.k.dropna().between(-1e-9, 100 + 1e-9).all() and df.adx.dropna().between(0, 100).all()


def test_rsi_target_price_hits_target():
    rng = np.random.default_rng(2)
    x = 50 + rng.normal(size=60).cumsum()
    for target in (30, 50, 70):
        price = k.rsi_price(x, 14, target)[-1]
        assert abs(k.rsi(np.append(x, price), 14)[-1] - target) < 1e-6


def test_pivots_zigzag_and_monotone():
    x = np.array([10, 12, 9, 11, 8, 13, 13, 9.0])
    found = k.pivots(x, 15)
    assert [(i, s) for i, s, _ in found] == [(0, -1), (1, 1), (2, -1), (3, 1), (4, -1), (5, 1)]
    assert k.pivots(np.arange(1, 20.0), 10) == [(0, -1, 1)]  # a rise has its start as a trough and no peak
    assert np.isnan(k.zigzag(x, 90)).all()


def test_stops_follow_their_side():
    up = k.Bars(pd.DataFrame({"open": range(10, 60), "high": range(11, 61), "low": range(9, 59), "close": range(10, 60), "volume": [1] * 50}))
    line, side = k.supertrend(up)
    assert (side[1:] == 1).all() and (np.diff(line[15:]) >= 0).all() and (line[15:] < up.c[15:]).all()
    assert (k.parabolic_sar(up)[2:] < up.l[2:]).all()


def test_candles_engulfing(spark):
    rows = [("A", datetime.date(2024, 1, i + 1), *x, 1) for i, x in enumerate([(10.0, 10.5, 8.5, 9.0), (8.8, 11.0, 8.7, 10.6)])]
    f = Frame(spark.createDataFrame(rows, "ticker string, ts date, open double, high double, low double, close double, volume long"))
    assert column(f, F.coalesce(candles.bullish(f)["bull_engulfing"], F.lit(False))) == [False, True]


def test_harmonic_gartley(spark):
    points = [(0, 1, 50.0), (5, -1, 100.0), (10, 1, 100 + 0.618 * -50.0), (15, -1, 69.1 + 0.6 * 30.9), (20, 1, 100 - 0.786 * 50)]
    df = spark.createDataFrame([("A", datetime.date(2024, 1, 1 + b), b, -s, p) for b, s, p in points], "ticker string, ts date, bar int, side int, price double")
    assert [(r.pattern, r.side) for r in patterns.harmonics(df).collect()] == [("gartley", 1)]


def test_compress_and_expand(spark):
    df = bars(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0])  # 2024-01-01 is a Monday
    week = timeframes.compress(df, "W").orderBy("ts").collect()
    assert [(w.open, w.close, w.volume) for w in week] == [(1.0, 7.0, 70), (8.0, 9.0, 20)]
    back = timeframes.expand(df.select("ticker", "ts"), timeframes.compress(df, "W").withColumnRenamed("close", "week_close"), "W", ["week_close"]).orderBy("ts").collect()
    assert [r.week_close for r in back] == [None] * 7 + [7.0] * 2


def test_ledger_pairs_signals(spark):
    f = Frame(bars(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]))
    day = F.dayofmonth("ts")
    t = trades.ledger(f, f.hold(day.isin(1, 2)), f.hold(day == 4)).collect()
    assert [(r.entry_price, r.exit_price) for r in t] == [(2.0, 5.0)] and abs(t[0].profit - 1.5) < 1e-12


def test_vpa_sheet_runs_on_short_series(spark):
    f = vpa.scanned(bars(spark, [1.0, 2.0, 3.0]))
    assert f.add(**vpa.sheet(f)).df.count() == 3


def test_breadth_counts(spark):
    df = bars(spark, [1.0, 2.0]).union(bars(spark, [2.0, 1.0], "B")).union(bars(spark, [1.0, 1.0], "C"))
    r = crosssection.breadth(df).orderBy("ts").collect()[1]
    assert (r.advancing, r.declining, r.unchanged) == (1, 1, 1)


def test_double_extremes_and_impulse(spark):
    schema = "ticker string, ts date, bar int, side int, price double"
    row = lambda b, s, p: ("A", datetime.date(2024, 1, 1) + datetime.timedelta(days=b), b, s, p)
    twice = spark.createDataFrame([row(0, 1, 100.0), row(5, -1, 90.0), row(10, 1, 101.0)], schema)
    assert [r.pattern for r in patterns.double_extremes(twice, F.col("before") * 0.03).collect()] == ["double top"]
    wave = spark.createDataFrame([row(0, -1, 10.0), row(5, 1, 20.0), row(10, -1, 15.0), row(15, 1, 35.0), row(20, -1, 25.0), row(25, 1, 40.0)], schema)
    found = patterns.impulses(wave).collect()
    assert [(r.side, r.price, r.fourth_ratio) for r in found] == [(1, 40.0, 0.5)]


def test_next_macd_change_meets_the_signal():
    rng = np.random.default_rng(5)
    x = 100 + rng.normal(size=80).cumsum()
    change = k.macd_next_change(x)[-1]
    y = np.append(x, x[-1] * (1 + change / 100))
    assert abs(k.macd(y)[-1] - k.macd_signal(y)[-1]) < 1e-9


def test_cointegrated_series_have_a_low_statistic():
    rng = np.random.default_rng(6)
    x = rng.normal(size=400).cumsum() + 50
    ratio, _, t = k.cointegration(2 * x + rng.normal(size=400), x)
    assert abs(ratio - 2) < 0.1 and t < -5
    assert all(np.isnan(v) for v in k.cointegration(x[:5], x[:5]))


def test_rounding_is_the_same_everywhere(spark):
    from tickloom.plans.sqltext import rounded

    assert [r[0] for r in spark.createDataFrame([(1867.84875,), (-0.00005,), (None,)], "x double").select(rounded(F.col("x"))).collect()] == [1867.8488, 0.0, None]


def test_correlation_without_variance_is_null(spark):
    f = Frame(bars(spark, [1.0, 2.0, 3.0]))
    assert column(f, f.corr("close", "volume", 2)) == [None, None, None]


def test_backward_reads_from_the_end(spark):
    g = Frame(bars(spark, [1.0, 2.0, 3.0])).backward()
    assert column(g, g.bar()) == [2, 1, 0]
    assert column(g, g.ref("close", -1)) == [2.0, 3.0, None]


def test_line_between_two_bars(spark):
    f = Frame(bars(spark, [5.0, 1.0, 7.0, 3.0, 9.0]))
    assert column(f, f.line_between(("close", 3), ("close", 1))) == [None, 1.0, 2.0, 3.0, 4.0]


def test_rotation_keeps_its_places_with_slack(spark):
    days = [{"A": 9.0, "B": 8.0, "C": 7.0}, {"A": 7.0, "B": 9.0, "C": 8.0}, {"A": None, "B": 1.0, "C": 2.0}]
    rows = [(t, datetime.date(2024, 1, 1 + i), s) for i, day in enumerate(days) for t, s in day.items()]
    held = crosssection.rotation(spark.createDataFrame(rows, "ticker string, ts date, score double"), "score", 1, slack=1)
    got = {(x.ticker, x.ts.day): x.held for x in held.collect()}
    assert got == {("A", 1): True, ("B", 1): False, ("C", 1): False, ("A", 2): False, ("B", 2): True, ("C", 2): False, ("B", 3): True, ("C", 3): True}


def test_targets_are_passed_in_order(spark):
    f = Frame(bars(spark, [10.0, 11.0, 12.0, 14.0, 13.0, 9.0, 7.0]))
    buy, short = F.col("close") == 11, F.col("close") == 9
    made = trades.targets(f, buy, short, F.col("close") - 2, F.col("close") + 1)
    assert column(f, made["long_1"]) == [False, False, False, True, True, False, False]
    assert column(f, made["long_2"]) == [False] * 7
    assert column(f, made["short_1"]) == [False] * 6 + [True]
    assert column(f, made["short_2"]) == [False] * 6 + [True]


def test_correlations_keep_every_ticker_and_fill_the_list(spark):
    a, b = bars(spark, [1.0, 2.0, 4.0, 8.0]), bars(spark, [8.0, 4.0, 2.0, 1.0], "B")
    late = bars(spark, [5.0, 6.0], "C", start=datetime.date(2024, 1, 3))
    gap = a.where("close != 2.0")  # the listed symbol lacks a day and keeps its last close
    got = {(x.a, x.b): (None if x["corr"] is None else round(x["corr"], 6), x.n) for x in crosssection.correlations(gap.union(b).union(late), "A", 4).collect()}
    want = float(np.corrcoef([8, 4, 2, 1], [1, 1, 4, 8])[0, 1])
    assert got == {("A", "A"): (None, 3), ("B", "A"): (round(want, 6), 4), ("C", "A"): (None, 2)}


def test_sheet_is_sorted_and_has_totals(spark):
    rows = spark.createDataFrame([("A", 1.0), ("B", 3.0), ("C", 3.0)], "ticker string, v double")
    got = crosssection.sorted_by(crosssection.with_summary(rows, "TOTAL", v="sum"), "-v", "ticker").collect()
    assert [(x.ticker, x.v) for x in got] == [("TOTAL", 7.0), ("B", 3.0), ("C", 3.0), ("A", 1.0)]


def test_strength_signs_need_later_bars_only_where_stated(spark):
    closes = (50 + np.cumsum(np.random.default_rng(3).normal(0, 1, 160))).round(2).tolist()
    volume = np.random.default_rng(4).integers(10, 400, 160).tolist()

    def signs(n):
        f = Frame(bars(spark, closes[:n], volume=volume[:n]))
        return f.add(**vpa.strength_and_weakness(f, F.lit(1.5))).df.orderBy("ts").toPandas()

    whole, part = signs(160), signs(140)
    names = [c for c in part if c[:3] in ("sos", "sow")]
    assert len(names) == 16
    ahead = ("sos7", "sow7")
    causal = [c for c in names if c not in ahead]
    assert whole[causal][:140].equals(part[causal]) and whole[list(ahead)][:139].equals(part[list(ahead)][:139])
