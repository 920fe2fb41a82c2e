"""Levels, lines, channels and patterns on swings that are known: each takes effect on the bar that confirms it.

``marked`` puts the swings into a frame on their confirming bars; everything
else is a window along the ticker's bars, so what a bar shows does not change
when later bars come.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import recur as k
from tickloom.functions import swings as sw
from tickloom.functions.frame import Frame
from tickloom.operators.scan import scan

MARK = ("swing_side", "swing_bar", "swing_price")


def mark_steps(pct: float, high: str = "c", low: str = "c", names: tuple[str, ...] = MARK) -> dict:
    """Scan steps for the marks of swings of ``pct`` percent over two of a bar's arrays (o, h, l, c)."""
    marks = lambda b: b.once(confirmed_of, high, low, pct)
    return {n: (lambda b, i=i: marks(b)[:, i]) for i, n in enumerate(names)}


def confirmed_of(b: k.Bars, high: str, low: str, pct: float):
    return sw.confirmed(getattr(b, high), getattr(b, low), pct)


def marked(bars: DataFrame, pct: float, high: str = "c", low: str = "c") -> Frame:
    return Frame(scan(bars, mark_steps(pct, high, low)))


def last_two(f: Frame, side: int, names: tuple[str, ...] = MARK) -> tuple[Column, Column]:
    """The last swing of a side known on each bar, and the one before it, as (bar, price)."""
    kind, bar, price = names
    now = f.hold(F.when(F.col(kind) == side, F.struct(F.col(bar).alias("bar"), F.col(price).alias("price"))))
    earlier = F.last(now, ignorenulls=True).over(f.w.rowsBetween(Window.unboundedPreceding, -1))
    before = f.hold(F.when(now.isNotNull(), F.struct(earlier.alias("v"))))
    held = f.hold_all({"one": F.last(now, ignorenulls=True).over(f.so_far), "two": F.last(before, ignorenulls=True).over(f.so_far)})
    return held["one"], held["two"]["v"]


def peak_breaks(f: Frame) -> dict[str, Column]:
    """Crossings of the close over the last peak, and under the last trough, known on the bar before; each until the other comes."""
    upper, lower = (f.hold(f.ref(f.hold(last_two(f, s)[0]["price"]), -1)) for s in (1, -1))
    up, down = f.hold(f.cross("close", upper)), f.hold(f.cross(lower, "close"))
    return {"upper": upper, "lower": lower, "buy": f.exrem(up, down), "sell": f.exrem(down, up)}


def trend_lines(f: Frame, names: tuple[str, ...] = MARK) -> dict[str, Column]:
    """The line through the last two bottoms if they rise, and through the last two tops if they fall, and closes that break them."""
    bar, out = f.hold(f.bar()), {}
    for side, name in ((-1, "low"), (1, "top")):
        one, two = last_two(f, side, names)
        slope = F.try_divide(two["price"] - one["price"], two["bar"] - one["bar"])
        line = f.hold(F.when(side * (two["price"] - one["price"]) > 0, one["price"] + slope * (bar - one["bar"])))
        out |= {f"line_{name}": line, f"break_{name}": f.cross(line, "close") if side < 0 else f.cross("close", line)}
    return out


RSI_MARK = ("rsi_side", "rsi_bar", "rsi_price")


def rsi_of(b: k.Bars, n: int):
    return k.rsi(b.c, n)


def rsi_marks(b: k.Bars, n: int, pct: float):
    rsi = b.once(rsi_of, n)
    marks = sw.confirmed(rsi, rsi, pct)
    return marks, sw.segment_lines(rsi, marks)


def channel_of(b: k.Bars, n: int, pct: float, width: float):
    rsi, lines = b.once(rsi_of, n), b.once(rsi_marks, n, pct)[1]
    first, level, slope, error = k.carried_on(lines, ~np.isnan(lines[:, 0])).T
    middle = level + slope * (np.arange(b.n) - first)
    top, low = middle + width * error, middle - width * error
    up, down = k.cross(rsi, top), k.cross(low, rsi)
    return top, low, up, down, k.exrem(up, down), k.exrem(down, up)


def rsi_channel(bars: DataFrame, pct: float = 35, n: int = 14, width: float = 2.0) -> Frame:
    """RSI, the line through its values between the last two swings carried on, the channel of ``width`` standard errors, and crossings out of it."""
    names = ("channel_top", "channel_low", "buy_channel", "sell_channel", "buy", "sell")
    steps = {"rsi": lambda b: b.once(rsi_of, n)} | {x: (lambda b, i=i: b.once(channel_of, n, pct, width)[i]) for i, x in enumerate(names)}
    f = Frame(scan(bars.select("ticker", "ts", "close"), steps, keep=("ticker", "ts")))  # a task's sorts hold only what the scan reads
    return f.add(**{x: F.col(x) == 1 for x in names[2:]})


def major_levels(bars: DataFrame, n: int = 2, kept: int = 6) -> DataFrame:
    """Major peaks and valleys: turns of a fast average whose smoothed extreme is beyond those of the turns before and after.

    ``from_bar`` is the bar that makes a level known (the next turn is known one
    bar after it), ``until_bar`` the one on which the ``kept``-th later level of
    its side takes its place; ``nth`` counts the last ``kept`` from the newest.
    """
    f = Frame(scan(bars, {x: (lambda b, x=x: b.once(sw.turn_inputs, n)[x]) for x in ("tema_high", "tema_low", "ha_high", "ha_low")}))
    look = f.hold_all({"bar": f.bar(), **{f"{x}{i}": f.ref(f"tema_{x}", i) for x in ("high", "low") for i in (-1, 1)}})
    top = (F.col("tema_high") > look["high-1"]) & (look["high1"] < F.col("high"))
    low = (F.col("tema_low") < look["low-1"]) & (look["low1"] > F.col("low"))
    turn = lambda side, cond, price: F.when(cond, F.struct(F.lit(side).alias("side"), F.col(price).alias("price")))
    turns = f.df.select("ticker", "ts", look["bar"].alias("bar"), F.explode(F.array_compact(F.array(turn(1, top, "ha_high"), turn(-1, low, "ha_low")))).alias("t")).select("ticker", "ts", "bar", "t.*")
    w = Window.partitionBy("ticker", "side").orderBy("bar")
    beyond = lambda x: F.col("side") * (F.col("price") - x) > 0
    near = turns.withColumns({"before": F.lag("price").over(w), "after": F.lead("price").over(w), "from_bar": F.lead("bar").over(w) + 1})
    major = near.where(beyond(F.col("before")) & beyond(F.col("after")))
    nth = F.row_number().over(Window.partitionBy("ticker", "side").orderBy(F.desc("bar")))
    ranked = major.withColumns({"until_bar": F.lead("from_bar", kept).over(w), "nth": nth})
    return ranked.select("ticker", "side", "ts", "bar", "price", "from_bar", "until_bar", F.when(F.col("nth") <= kept, F.col("nth")).alias("nth"))


#: Published ranges of B in XA, C in AB and D in XA, and the point that D must pass.
TRAIL_HARMONICS = {
    "gartley": ((0.55, 0.72), (0.38, 1.0), (0.55, 1.0), "b"),
    "bat": ((0.38, 0.55), (0.38, 1.27), (0.5, 1.0), "b"),
    "butterfly": ((0.55, 0.9), (0.38, 1.27), (1.0, 1.38), "x"),
    "crab": ((0.38, 0.65), (0.38, 1.27), (1.25, 1.8), "x"),
}
LEG = ("leg", "fresh", "side", "bar", "price", "low_to", "high_to")


def legs_of(b: k.Bars, bull: float, bear: float, n: int):
    return sw.trail_legs(b, sw.close_trail(b, bull, bear, n))


def trail_harmonics(bars: DataFrame, bull: float = 2.0, bear: float = 2.0, n: int = 20) -> DataFrame:
    """Harmonic patterns X, A, B, C on the extremes between reversals of a trailing stop, on the bars where D is reached.

    Side 1 ends in a low.  Only the last C of a side that fits any pattern
    counts; from its bar on no high may pass it, and D is a new low of its leg
    inside the pattern's range of XA, below B (X for the last two patterns).
    """
    f = Frame(scan(bars, {x: (lambda b, x=x: b.once(legs_of, bull, bear, n)[x]) for x in LEG}))
    swing = f.hold(F.when(F.col("side").isNotNull(), F.struct("side", "price", "low_to", "high_to")))
    points = [swing]
    for _ in range(3):  # on the bar of a swing, the ones before it
        points.append(f.hold(F.when(swing.isNotNull(), F.last(points[-1], ignorenulls=True).over(f.w.rowsBetween(Window.unboundedPreceding, -1)))))
    c, b, a, x = (p["price"] for p in points)
    out = []
    for side in (1, -1):
        ab, bc = F.try_divide(side * (a - b), side * (a - x)), F.try_divide(side * (c - b), side * (a - b))
        inside = lambda v, r: (v > r[0]) & (v < r[1])
        fits = F.array_compact(F.array(*[F.when(inside(ab, rb) & inside(bc, rc), F.lit(name)) for name, (rb, rc, _, _) in TRAIL_HARMONICS.items()]))
        found = f.hold(F.when((swing["side"] == side) & (F.size(fits) > 0), F.struct(x.alias("x"), a.alias("a"), b.alias("b"), c.alias("c"), fits.alias("fits"), swing["low_to"].alias("low_to"), swing["high_to"].alias("high_to"))))
        held = f.hold(F.last(found, ignorenulls=True).over(f.so_far))
        low = f.hold(F.least(held["low_to"], f.since(found.isNotNull(), "low", top=False)))
        high = f.hold(F.greatest(held["high_to"], f.since(found.isNotNull(), "high")))
        now, worst, best = (F.col("low"), low, high) if side > 0 else (F.col("high"), high, low)
        at_end = (F.col("leg") == -side) & (F.col("fresh") == 1) & (worst == now) & (side * (best - held["c"]) <= 0)
        hit = F.lit(None).cast("string")
        for name, (_, _, (near, far), passed) in reversed(TRAIL_HARMONICS.items()):
            depth = side * (held["a"] - held["x"])
            reached = F.array_contains(held["fits"], name) & (side * (held["a"] - worst) > depth * near) & (side * (held["a"] - worst) < depth * far) & (side * (worst - held[passed]) < 0)
            hit = F.when(reached, name).otherwise(hit)
        out.append(F.when(at_end & hit.isNotNull(), F.struct(F.lit(side).alias("pattern_side"), hit.alias("pattern"), now.alias("d"), *[held[p].alias(p) for p in "xabc"])))
    return f.df.select("ticker", "ts", F.explode(F.array_compact(F.array(*out))).alias("p")).select("ticker", "ts", F.col("p.pattern_side").alias("side"), "p.pattern", "p.x", "p.a", "p.b", "p.c", "p.d")
