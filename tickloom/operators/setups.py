"""Two-bar and trend set-ups: pin bars, and the pivots of a trend that changes with the newer extreme."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import recur
from tickloom.functions.frame import Frame
from tickloom.operators import indicators
from tickloom.operators.scan import scan

#: The published bounds of a pin bar (nose) and the bar before it (left eye), as shares of lengths and bodies.
PIN_BAR = {"most_body": 0.33, "body_position": 0.4, "least_eye_body": 0.1, "protruding": 0.5, "body_to_eye": 1.0, "length_to_eye": 0.0, "eye_depth": 0.2}


def pin_bars(f: Frame, opposite_eye: bool = True, same_direction: bool = False, inside_body: bool = False, point: float = 0.1, **bounds: float) -> dict[str, Column]:
    """Bars that stick out of the one before by half their length and close near their other end; +1 bullish, -1 bearish is told by name.

    ``opposite_eye``: the bar before goes against the pattern; ``same_direction``:
    the pin goes with it; ``inside_body``: its body lies in that of the bar before.
    A length or body of zero counts as ``point``.  ``bounds`` replace those of PIN_BAR.
    """
    if unknown := bounds.keys() - PIN_BAR.keys():
        raise ValueError(f"a pin bar has no bound {', '.join(sorted(unknown))}")
    k = PIN_BAR | bounds
    before = f.hold_all({c: f.ref(c, -1) for c in ("open", "high", "low", "close")})
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    some = lambda x: F.when(x == 0, point).otherwise(x)
    nose, eye = some(h - l), some(before["high"] - before["low"])
    body, eye_body = some(F.abs(o - c)), some(F.abs(before["open"] - before["close"]))
    top, low, eye_top, eye_low = F.greatest(o, c), F.least(o, c), F.greatest(before["open"], before["close"]), F.least(before["open"], before["close"])
    shape = (body / nose <= k["most_body"]) & (eye_body / eye >= k["least_eye_body"]) & (body / eye_body <= k["body_to_eye"]) & (nose / eye >= k["length_to_eye"])
    inside = (top <= before["high"]) & (low >= before["low"])
    if inside_body:
        inside = inside & (top <= eye_top) & (low >= eye_low)
    out = {}
    for name, side in (("bullish_pin", 1), ("bearish_pin", -1)):
        sticks = before["low"] - l if side > 0 else h - before["high"]
        back = before["high"] - h if side > 0 else l - before["low"]
        tail = low - l if side > 0 else h - top
        hit = shape & inside & (sticks >= nose * k["protruding"]) & (1 - tail / nose < k["body_position"]) & (back >= eye * k["eye_depth"])
        if opposite_eye:
            hit = hit & (side * (before["close"] - before["open"]) < 0)
        if same_direction:
            hit = hit & (side * (c - o) > 0)
        out[name] = F.coalesce(hit, F.lit(False))
    return out


def trend_pivots(f: Frame, n: int = 12, last: int | None = None) -> DataFrame:
    """Pivots where the trend changes: it is down while the low of ``n`` bars is newer than their high, else up.

    The extreme of the trend that ended is a pivot, known on the first bar of the
    new trend (``known_bar``); with ``last``, those known on a ticker's last bars
    only.  ``nth`` counts a side's pivots from the newest.
    """
    spans = f.hold_all({"bar": f.bar(), "high": f.hhvbars("high", n), "low": f.llvbars("low", n)})
    down = f.hold(spans["low"] < spans["high"])
    was = f.hold_all({"down": f.ref(down, -1), "high": f.ref(spans["high"], -1), "low": f.ref(spans["low"], -1), "end": F.max(spans["bar"]).over(f.whole)})
    side = F.when(was["down"], -1).otherwise(1)
    back = F.when(was["down"], was["low"]).otherwise(was["high"])
    rows = f.df.where(was["down"].isNotNull() & (down != was["down"]))
    if last is not None:
        rows = rows.where(spans["bar"] > was["end"] - last)
    found = rows.select("ticker", "ts", side.alias("side"), (spans["bar"] - 1 - back).alias("bar"), spans["bar"].alias("known_bar"))
    prices = f.df.select("ticker", spans["bar"].alias("bar"), "high", "low")
    nth = F.row_number().over(Window.partitionBy("ticker", "side").orderBy(F.desc("known_bar")))
    priced = found.join(prices, ["ticker", "bar"]).withColumn("price", F.when(F.col("side") > 0, F.col("high")).otherwise(F.col("low")))
    return priced.select("ticker", "ts", "side", "bar", "known_bar", "price", nth.alias("nth"))


def spaced(f: Frame, signals: dict[str, Column], n: int) -> DataFrame:
    """The frame's rows with each signal, those within ``n`` bars of one that passed being silent; one grouped pass for all."""
    f.add(**{f"_raw_{name}": F.coalesce(x, F.lit(False)).cast("int") for name, x in signals.items()})
    steps = {name: (lambda b, name=name: recur.exrem_span(b.g[f"_raw_{name}"].to_numpy(bool), n)) for name in signals}
    columns = [*f.given, *(f"_raw_{name}" for name in signals)]
    return scan(f.df.select(*columns), steps).drop(*(f"_raw_{name}" for name in signals))


def far_from_average(f: Frame, n: int = 50, least: float = 10, change: float = 15, over: int = 20, sessions: int = 200) -> dict[str, Column]:
    """Closes farther from their mean (in percent) than in any of ``sessions`` bars and than ``least``, after a change of over ``change`` percent: below to buy, above to sell."""
    away = f.hold(indicators.distance_from_ma(f, n))
    moved = F.abs(f.roc("close", over)) > change
    return {"away": away, "buy": (away <= f.llv(away, sessions)) & (away < -least) & moved, "sell": (away >= f.hhv(away, sessions)) & (away > least) & moved}


def far_steps(n: int = 50, least: float = 10, change: float = 15, over: int = 20, sessions: int = 200, silent: int = 20) -> dict:
    """``far_from_average`` as scan steps, its signals silent for ``silent`` bars after one that passed: long windows cost least as arrays."""
    away = lambda b: b.once(_away, n)
    moved = lambda b: np.abs(100 * (recur.div(b.c, recur.ref(b.c, -over)) - 1)) > change
    return {
        "away": away,
        "buy": lambda b: recur.exrem_span((away(b) <= recur.llv(away(b), sessions)) & (away(b) < -least) & moved(b), silent),
        "sell": lambda b: recur.exrem_span((away(b) >= recur.hhv(away(b), sessions)) & (away(b) > least) & moved(b), silent),
    }


def _away(b: recur.Bars, n: int):
    m = recur.ma(b.c, n)
    return 100 * recur.div(b.c - m, m)


def j_turns(f: Frame, n: int = 9, k: int = 3, d: int = 3, low: float = 0, high: float = 100) -> dict[str, Column]:
    """Turns of the J line from under ``low`` (to buy) and from over ``high`` (to sell)."""
    j = f.hold(indicators.kdj(f, n, k, d)["kdj_j"])
    one, two = f.hold(f.ref(j, -1)), f.hold(f.ref(j, -2))
    return {"j": j, "buy": (j > one) & (two > one) & (one < low), "sell": (j < one) & (two < one) & (one > high)}


def keltner_steps(n: int = 20, over: int = 10, times: tuple[float, ...] = (1, 2, 3)) -> dict:
    """Scan steps for an exponential mean and bands at several multiples of the mean true range about it."""
    middle = lambda b: b.once(_middle, n)
    wide = lambda b: b.once(recur.atr, over)
    return {"center": middle} | {f"{side}{k:g}": (lambda b, k=k, sign=sign: middle(b) + sign * k * wide(b)) for k in times for side, sign in (("top", 1), ("low", -1))}


def _middle(b: recur.Bars, n: int):
    return recur.ema(b.c, n)
