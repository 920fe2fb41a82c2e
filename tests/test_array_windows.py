"""Window measures that a grouped scan computes as arrays: the same as the column builders, and without Spark windows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tickloom.functions import recur as k
from tickloom.functions.frame import Frame
from tickloom.operators import indicators as ind
from tickloom.operators.scan import scan

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def some_bars(spark):
    rng, rows = random.Random(4), []
    for ticker, n in (("A", 70), ("B", 12), ("C", 1)):
        for i in range(n):
            o, c = (2.0, 2.0) if 30 <= i < 55 else (rng.uniform(1, 3), rng.uniform(1, 3))
            rows.append((ticker, datetime.date(2024, 1, 1) + datetime.timedelta(i), o, max(o, c), min(o, c), c, rng.randrange(1, 50)))
    return spark.createDataFrame(rows, "ticker string, ts date, open double, high double, low double, close double, volume long").cache()


def same(df, columns, steps):
    made = scan(df, steps, keep=("ticker", "ts"))
    one = {(r.ticker, r.ts): r for r in columns.collect()}
    rows = made.collect()
    assert len(rows) == len(one) and made.columns == ["ticker", "ts", *steps]
    for r in rows:
        for n in steps:
            x, y = r[n], one[r.ticker, r.ts][n]
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-6 * max(1, abs(y))), (n, r.ticker, r.ts, x, y)


def test_statistics(spark, some_bars):
    assert "Window" not in plan(__spark_entry__.queries()["b_statistics"](spark, SMALL))
    f = Frame(some_bars)
    columns = {"sd": f.stdev("close", 20), "sample": f.stdev("close", 20, False), "corr": f.corr("close", F.col("volume").cast("double"), 20), "slope": f.slope("close", 20), "line": f.linreg("close", 20, 1), "error": f.stderr("close", 20)}
    steps = {"sd": lambda b: k.stdev(b.c, 20), "sample": lambda b: k.stdev(b.c, 20, False), "corr": lambda b: k.corr(b.c, b.v, 20), "slope": lambda b: k.slope(b.c, 20), "line": lambda b: k.linreg(b.c, 20, 1), "error": lambda b: k.stderr(b.c, 20)}
    same(some_bars, f.add(**columns).df, steps)


def test_oscillators(spark, some_bars):
    assert "Window" not in plan(__spark_entry__.queries()["i_oscillators"](spark, SMALL))
    f = Frame(some_bars)
    columns = {"cci": ind.cci(f), "mfi": ind.mfi(f), "williams": ind.williams_r(f), "ultimate": ind.ultimate(f), "dpo": ind.dpo(f), "psych": ind.psychological(f), "position": ind.range_position(f, 14), "up": ind.aroon(f)["aroon_up"], "down": ind.aroon(f)["aroon_down"], "ac": ind.awesome(f)["ac"], "j": ind.kdj(f)["kdj_j"]}
    steps = {"cci": k.cci, "mfi": k.mfi, "williams": k.williams, "ultimate": k.ultimate, "dpo": k.dpo, "psych": k.psychological, "position": k.range_position, "up": lambda b: k.aroon(b)[0], "down": lambda b: k.aroon(b)[1], "ac": lambda b: k.awesome(b)[1], "j": lambda b: k.kdj(b)[2]}
    same(some_bars, f.add(**columns).df, steps)


def test_break_signals_scan_once(spark):
    text = plan(__spark_entry__.queries()["e22_break_signals"](spark, SMALL))
    assert "Window" not in text and text.index("Sort [industry") < text.index("RepartitionByExpression") < text.index("FlatMapGroupsInArrow")


def test_far_from_average(spark, some_bars):
    from tickloom.operators import setups

    assert "Window" not in plan(__spark_entry__.queries()["a_far_from_average"](spark, SMALL))
    f = Frame(some_bars)
    made = setups.far_from_average(f, 5, 1, 2, 3, 10)
    f.given.append("away")
    f.add(away=made.pop("away"))
    same(some_bars, setups.spaced(f, made, 4), setups.far_steps(5, 1, 2, 3, 10, 4))


def test_rsi_channel_sorts_slim_rows(spark):
    """One sort for the scan, of the ticker, time and close alone, and no windows after it."""
    text = plan(__spark_entry__.queries()["i_rsi_channel"](spark, SMALL))
    assert "Window" not in text and "high" not in text.split("FlatMapGroupsInArrow")[1] and "volume" not in text.split("FlatMapGroupsInArrow")[1]


def test_points_of_a_sweep_share_windows(spark, some_bars):
    """Equal windows of a chunk's points are made once."""
    from tickloom.operators import parameters as pm

    pm.RULES["shared_windows"] = (lambda b, length: (b.c == b.c) & (k.ma(b.c, 3) is k.ma(b.c, 3))), (pm.Param("length", 1, 1, 3),)
    try:
        rows = pm.sweep(some_bars, "shared_windows", chunk=2).collect()
    finally:
        del pm.RULES["shared_windows"]
    assert len(rows) == 9 and {r.trades for r in rows} == {1}


def test_volume_price_sheet_needs_few_windows(spark):
    """Means, extremes and slopes come from the scan; what is left to windows are lags."""
    text = plan(__spark_entry__.queries()["q_volume_price_sheet"](spark, SMALL))
    assert not any(f in text for f in ("avg(", "regr_slope", "stddev_pop", "collect_list"))


def test_classes_scan_what_they_read(spark):
    text = plan(__spark_entry__.queries()["q_classes"](spark, SMALL))
    assert "Window" not in text and "up_long" not in text


def test_small_splits_share_a_task():
    from tickloom.sources import barsource

    assert barsource.split_for(17 << 20, 1 << 16, 16) == -(-(17 << 20) // 16)
    assert barsource.split_for(1 << 40, 1 << 16, 16) == barsource.SPLIT_BYTES and barsource.split_for(1 << 10, 1 << 16, 16) == 1 << 16
    assert barsource.split_for(1 << 30, 1 << 16, 0) == 1 << 16


def test_candles(spark, some_bars):
    """The flags of one scan are those of the column builders, also at a ticker's first bars and on level ones."""
    from tickloom.operators import candles

    assert "Window" not in plan(__spark_entry__.queries()["k_candles"](spark, SMALL))
    f, flags = candles.scanned_flags(some_bars)
    g = Frame(some_bars)
    columns = candles.vocabulary(g) | candles.single(g) | candles.simple(g)
    assert list(flags) == list(columns)
    got = {(r.ticker, r.ts): r.asDict() for r in f.add(**flags).select("ticker", "ts", *flags).collect()}
    want = {(r.ticker, r.ts): r.asDict() for r in g.add(**{n: x.cast("long") for n, x in columns.items()}).select("ticker", "ts", *columns).collect()}
    assert got == want and {n for r in want.values() for n, x in r.items() if x == 1 and n in columns} >= {"white", "black", "bull_engulfing", "double_gap_up", "doji"}
