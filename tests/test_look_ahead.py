"""Every column builder on all bars and on the first of them: what is not in LOOK_AHEAD must not change."""

import datetime
import inspect

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions import recur as k
from tickloom.functions.frame import LOOK_AHEAD, Frame
from tickloom.operators import candles, indicators, patterns, timeframes, vpa
from tickloom.operators.scan import scan

ALL, PART = 190, 147  # the first bars end with a week
SKIPPED: set[str] = set()
GIVEN = {  # made when a session is there
    "x": "close", "n": 10, "rsi": lambda: F.lit(30.0), "adx": lambda: F.lit(30.0), "atr": "spread", "change": 1.0, "entry": "close", "stop": "low", "interest": "volume", "volume": "volume", "ts": "ts", "bought": "volume", "sold": "spread",
    "high": lambda: F.col("high"), "low": lambda: F.col("low"), "close": lambda: F.col("close"), "positive": True, "mean_range": lambda: F.lit(1.5), "cond": lambda: F.col("close") > F.col("open"), "a": "close", "b": "open", "signal": lambda: F.col("close") > F.col("open"), "y": "volume",
}
#: Whose arguments are not columns of a frame, or which need columns of their own and are tried elsewhere.
ELSEWHERE = {"session_minutes", "expected_volume", "last_thursday", "period", "near", "all_of", "said", "any_of", "bodies", "first_label", "all_labels", "hit_rates", "bands", "volume_class", "spread_class", "close_class", "composites", "texts", "trend_events", "signals", "effort_and_reversals", "sheet", "forces", "compress", "expand", "price_of", "on_periods", "scanned", "random_walk"}


def frame_of(spark, n):
    draw = np.random.default_rng(5)
    close = 50 + np.cumsum(draw.normal(0, 1, ALL))
    spread = np.abs(draw.normal(0, 1, (2, ALL)))
    opens = np.roll(close, 1) + draw.normal(0, 0.5, ALL)
    bars = pd.DataFrame({"ticker": "A", "ts": [datetime.date(2024, 1, 1) + datetime.timedelta(i) for i in range(ALL)], "open": opens, "high": np.maximum(opens, close) + spread[0], "low": np.minimum(opens, close) - spread[1], "close": close, "volume": draw.integers(1, 900, ALL), "spread": spread[0]})
    return bars.head(n)


def builders():
    out = {}
    for module in (indicators, candles, patterns, timeframes, vpa):
        for name, make in inspect.getmembers(module, inspect.isfunction):
            if make.__module__ == module.__name__ and not name.startswith("_") and name not in ELSEWHERE and name not in ("pivot_rows", "swing_labels", "harmonics", "wolfe_waves", "double_extremes", "impulses", "level_breaks"):
                out[name] = make
    for name, make in inspect.getmembers(Frame, inspect.isfunction):
        if not name.startswith("_") and name not in ("hold", "hold_all", "add", "select", "back", "backward", "line_between", "ref", "value_when"):
            out[name] = make
    return out


def called(make, f):
    """The columns that a builder makes of a frame, its arguments by their names; None if it isn't a builder of columns."""
    args = {}
    for p in inspect.signature(make).parameters.values():
        if p.name in ("f", "self"):
            args[p.name] = f
        elif p.default is inspect.Parameter.empty:
            if p.name not in GIVEN:
                return None
            args[p.name] = GIVEN[p.name]() if callable(GIVEN[p.name]) else GIVEN[p.name]
    made = make(**args)
    if isinstance(made, tuple):
        made = {str(i): c for i, c in enumerate(made)}
    made = {"value": made} if isinstance(made, Column) else made
    return {n: c for n, c in made.items() if isinstance(c, Column)} if isinstance(made, dict) else None


@pytest.fixture(scope="module")
def made(spark):
    """builder -> its columns on all bars cut to the first, and on the first alone; all in a few plans."""
    groups, rows = [[]], {}
    for name in builders():
        groups[-1].append(name)
        if len(groups[-1]) == 12:
            groups.append([])
    for n in (ALL, PART):
        source = spark.createDataFrame(frame_of(spark, n))
        for group in groups:
            f, columns = Frame(source), {}
            for name in group:
                try:
                    held = {f"{name}:{c}": f.hold(x) for c, x in (called(builders()[name], f) or {}).items()}
                except (TypeError, AnalysisException):  # it takes other things than columns of a frame
                    SKIPPED.add(name)
                    continue
                columns |= held
            if columns:
                got = f.df.orderBy("ts").select(*[c.cast("string").alias(n_) for n_, c in columns.items()]).limit(PART).toPandas()
                for c in columns:
                    rows.setdefault(c.split(":")[0], {}).setdefault(n, {})[c] = got[c].tolist()
    return rows


def test_every_builder(made):
    assert len(made) > 70 and len(SKIPPED) < 12, SKIPPED
    changed = {name for name, by in made.items() if by[ALL] != by[PART]}
    assert changed <= LOOK_AHEAD.keys(), changed - LOOK_AHEAD.keys()
    assert {"future", "last_value", "td_points", "regression_channel", "transaction_speed"} <= changed


def test_primitives_with_arguments(spark):
    def rows(n):
        f = Frame(spark.createDataFrame(frame_of(spark, n)))
        cond = f.hold(F.col("close") > F.col("open"))
        out = {"ref(n>0)": f.ref("close", 2), "ref": f.ref("close", -2), "value_when(n=0)": f.value_when(cond, "close", 0), "value_when": f.value_when(cond, "close", 2), "line_between": f.line_between(("low", 30), ("high", 3)), "week_end_value": timeframes.week_end_value(f, "close")}
        f.add(**out)
        b = Frame(f.df.drop(*[c for c in f.df.columns if c.startswith("_h")])).backward()
        b.add(backward=b.ma("close", 5))
        return b.df.orderBy("ts").select(*[F.col(f"`{c}`").cast("string").alias(c) for c in [*out, "backward"]]).limit(PART).toPandas()

    one, two = rows(ALL), rows(PART)
    assert {c for c in one if one[c].tolist() != two[c].tolist()} == {c for c in one if c in LOOK_AHEAD}


def test_functions_of_arrays():
    whole, parts = k.Bars(frame_of(None, ALL)), {n: k.Bars(frame_of(None, n)) for n in range(100, 190, 5)}
    made = {
        "zigzag": lambda b: k.zigzag(b.c, 5), "swing": lambda b: k.swing(b.c, 5, 1, True), "swing(causal)": lambda b: k.swing(b.c, 5, 1, True, causal=True), "rsi": lambda b: k.rsi(b.c), "adx": lambda b: k.directional(b)[2], "sar": k.parabolic_sar, "supertrend": lambda b: k.supertrend(b)[0],
        "stop": k.volatility_stop, "chandelier": k.chandelier, "trail": k.atr_trail, "darvas": lambda b: k.darvas(b)[0], "klinger": k.klinger, "t3": lambda b: k.t3(b.c, 5), "hma": lambda b: k.hma(b.c, 9), "schaff": lambda b: k.schaff(b.c), "wave": k.wave_trend, "regime": k.regime, "events": lambda b: k.macd_events(b.c),
        "divergence": lambda b: k.divergence(b.c, k.rsi(b.c)), "jnsar": k.jnsar, "percent_trail": lambda b: k.percent_trail(b.c), "phase": k.phase_trend,
    }
    same = lambda f: all(np.allclose(np.asarray(f(whole), float)[:n], np.asarray(f(part), float), equal_nan=True) for n, part in parts.items())
    assert {n for n, f in made.items() if not same(f)} == {n for n in made if n in LOOK_AHEAD}


def test_pivots_are_known_later(spark):
    def rows(n):
        p = patterns.pivot_rows(Frame(spark.createDataFrame(frame_of(spark, n))), 3)
        out = {"pivot_rows": p, "swing_labels": patterns.swing_labels(p), "double_extremes": patterns.double_extremes(p, F.lit(8.0))}
        return {c: sorted(map(str, df.where(F.col("bar") < PART).collect())) for c, df in out.items()}

    one, two = rows(ALL), rows(PART)
    assert all(one[c] != two[c] and c in LOOK_AHEAD for c in one)


def test_scans_keep_their_rows(spark):
    """The grouped scan itself adds no look-ahead."""
    cut = lambda n: scan(spark.createDataFrame(frame_of(spark, n)), {"ema": lambda b: k.ema(b.c, 9)}).orderBy("ts").limit(PART).toPandas()["ema"].tolist()
    assert np.allclose(cut(ALL), cut(PART))
