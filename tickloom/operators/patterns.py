"""Chart patterns on pivots: fractals, swing labels, double tops, harmonics, Wolfe waves, breakouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.frame import Frame

div = F.try_divide


def fractals(f: Frame, n: int = 5) -> dict[str, Column]:
    """Tops: the greatest high of 2n bars with n lower highs after it (looks ahead); bottoms likewise."""
    ahead = f.w.rowsBetween(1, n)
    top = (F.col("high") == f.hhv("high", 2 * n)) & (F.count("high").over(ahead) == n) & (F.max("high").over(ahead) < F.col("high"))
    low = (F.col("low") == f.llv("low", 2 * n)) & (F.count("low").over(ahead) == n) & (F.min("low").over(ahead) > F.col("low"))
    return {"top": F.coalesce(top, F.lit(False)), "bottom": F.coalesce(low, F.lit(False))}


def pivot_rows(f: Frame, n: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per pivot, sides alternating: of pivots of one side in a row the most extreme stays, the first of equals; with the columns ``keep`` of its bar."""
    marks = {k: f.hold(v) for k, v in fractals(f, n).items()}
    i = f.hold(f.bar())
    side = F.when(marks["top"], 1).when(marks["bottom"], -1)
    rows = f.df.where(marks["top"] | marks["bottom"]).select("ticker", "ts", i.alias("bar"), side.alias("side"), F.when(side == 1, F.col("high")).otherwise(F.col("low")).alias("price"), *keep)
    w = Window.partitionBy("ticker").orderBy("bar")
    island = rows.withColumn("new", F.coalesce((F.lag("side").over(w) != F.col("side")).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = island.groupBy("ticker", "island").agg(F.max_by(F.struct("ts", "bar", "side", "price", *keep), F.struct(F.col("side") * F.col("price"), -F.col("bar"))).alias("p"))
    return best.select("ticker", "p.*")


def swing_labels(pivots: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """HH, LH or DT for tops and HL, LL or DB for bottoms, against the last pivot of the side (within ``tolerance`` percent: double)."""
    before = F.lag("price").over(Window.partitionBy("ticker", "side").orderBy("bar"))
    double = F.abs(F.col("price") - before) <= before * tolerance / 100
    top = F.when(double, "DT").when(F.col("price") > before, "HH").when(F.col("price") < before, "LH")
    low = F.when(double, "DB").when(F.col("price") > before, "HL").when(F.col("price") < before, "LL")
    return pivots.withColumn("label", F.when(F.col("side") == 1, top).otherwise(low))


#: The published retracement ranges B of XA, C of AB and D of XA.
HARMONICS = {"gartley": ((0.55, 0.7), (0.382, 0.886), (0.74, 0.82)), "bat": ((0.35, 0.55), (0.382, 0.886), (0.84, 0.92)), "butterfly": ((0.72, 0.85), (0.382, 0.886), (1.2, 1.7)), "crab": ((0.35, 0.65), (0.382, 0.886), (1.55, 1.7))}


def harmonics(pivots: DataFrame) -> DataFrame:
    """Patterns of five alternating pivots X, A, B, C, D; side is 1 if D is a low (bullish).  Pivots look ahead, so D is known n bars later."""
    w = Window.partitionBy("ticker").orderBy("bar")
    p = pivots.select("*", *[F.lag("price", k).over(w).alias(n) for k, n in ((4, "x"), (3, "a"), (2, "b"), (1, "c"))])
    xa, ab = F.abs(F.col("a") - F.col("x")), F.abs(F.col("b") - F.col("a"))
    ratios = [div(ab, xa), div(F.abs(F.col("c") - F.col("b")), ab), div(F.abs(F.col("price") - F.col("a")), xa)]
    kind = F.lit(None).cast("string")
    for name, ranges in reversed(HARMONICS.items()):
        hit = F.lit(True)
        for value, (low, high) in zip(ratios, ranges):
            hit &= (value >= low) & (value <= high)
        kind = F.when(hit, name).otherwise(kind)
    abcd = div(F.abs(F.col("price") - F.col("c")), ab).between(0.95, 1.05) & ratios[1].between(0.55, 0.85)
    return p.withColumn("pattern", F.coalesce(kind, F.when(abcd, "abcd"))).where("pattern is not null and x is not null").select("ticker", "ts", "bar", (-F.col("side")).alias("side"), "pattern", "price")


def wolfe_waves(pivots: DataFrame) -> DataFrame:
    """Five pivots whose lines 1-3 and 2-4 converge, with 5 beyond the line 1-3; target is the line 1-4 at bar 5."""
    w = Window.partitionBy("ticker").orderBy("bar")
    cols = [F.lag(c, k).over(w).alias(f"{c[0]}{5 - k}") for k in range(1, 5) for c in ("price", "bar")]
    p = pivots.select("*", *cols)
    s = F.col("side")  # -1: a bullish wave ends in a low
    slope13, slope24 = div(F.col("p3") - F.col("p1"), F.col("b3") - F.col("b1")), div(F.col("p4") - F.col("p2"), F.col("b4") - F.col("b2"))
    line = F.col("p3") + slope13 * (F.col("bar") - F.col("b3"))
    beyond = s * (F.col("price") - line) >= 0
    ordered = (s * (F.col("p3") - F.col("p1")) > 0) & (s * (F.col("p4") - F.col("p1")) < 0) & (s * (F.col("p4") - F.col("p2")) > 0)
    converge = s * (slope24 - slope13) > 0
    target = F.col("p1") + div(F.col("p4") - F.col("p1"), F.col("b4") - F.col("b1")) * (F.col("bar") - F.col("b1"))
    return p.where(ordered & beyond & converge).select("ticker", "ts", (-s).alias("side"), "price", target.alias("target"))


def range_break(f: Frame, n: int = 20, volume: float = 1.5) -> dict[str, Column]:
    """Close beyond the range of the n bars before, on more than ``volume`` times their mean volume, and not within 3 bars of the last such."""
    top, low, mean = (f.hold(f.ref(f.hold(x), -1)) for x in (f.hhv("high", n), f.llv("low", n), f.ma("volume", n)))
    loud = F.coalesce(F.col("volume") > volume * mean, F.lit(False))
    return {"range_up": f.quiet(f.hold(F.coalesce(F.col("close") > top, F.lit(False)) & loud)), "range_down": f.quiet(f.hold(F.coalesce(F.col("close") < low, F.lit(False)) & loud))}


def sideways(f: Frame, n: int = 20, pct: float = 5.0) -> Column:
    low = f.hold(f.llv("low", n))
    return F.coalesce(100 * div(f.hhv("high", n) - low, low) < pct, F.lit(False))


def level_breaks(f: Frame, levels: DataFrame) -> DataFrame:
    """Crossings of given levels (ticker, kind "up" or "down", price)."""
    f.add(before=f.ref("close", -1))
    up = (F.col("kind") == "up") & (F.col("before") <= F.col("level")) & (F.col("close") > F.col("level"))
    down = (F.col("kind") == "down") & (F.col("before") >= F.col("level")) & (F.col("close") < F.col("level"))
    return f.df.join(levels.withColumnRenamed("price", "level"), "ticker").where(up | down).select("ticker", "ts", "kind", "level", "close")


def double_extremes(pivots: DataFrame, band: Column) -> DataFrame:
    """Tops (or bottoms) less than ``band`` from the last of their side, with a pivot between them."""
    before = F.lag("price").over(Window.partitionBy("ticker", "side").orderBy("bar"))
    rows = pivots.withColumn("before", before).where(F.abs(F.col("price") - F.col("before")) < band)
    return rows.select("ticker", "ts", "bar", F.when(F.col("side") == 1, "double top").otherwise("double bottom").alias("pattern"), "price")


def impulses(pivots: DataFrame) -> DataFrame:
    """Six pivots that obey the impulse rules: wave 2 stays off the start, 3 is not the shortest, 4 does not reach 1."""
    w = Window.partitionBy("ticker").orderBy("bar")
    p = pivots.select("*", *[F.lag("price", k).over(w).alias(f"p{5 - k}") for k in range(1, 6)])
    s = F.col("side")
    one, three, five = (s * (F.col(b) - F.col(a)) for a, b in (("p0", "p1"), ("p2", "p3"), ("p4", "price")))
    rules = (one > 0) & (s * (F.col("p2") - F.col("p0")) > 0) & (s * (F.col("p4") - F.col("p1")) > 0) & (three > F.least(one, five)) & (five > 0)
    ratio = div(s * (F.col("p3") - F.col("p4")), three)
    return p.where(rules).select("ticker", "ts", s.alias("side"), "price", ratio.alias("fourth_ratio"))


def shifted_break(f: Frame, n: int = 20, shift: int = 5) -> dict[str, Column]:
    """Close beyond the range of n bars that ended ``shift`` bars ago."""
    top, low = f.hold(f.ref(f.hold(f.hhv("high", n)), -shift)), f.hold(f.ref(f.hold(f.llv("low", n)), -shift))
    return {"shifted_up": F.coalesce(F.col("close") > top, F.lit(False)), "shifted_down": F.coalesce(F.col("close") < low, F.lit(False))}


def first_breaks(f: Frame, n: int = 20) -> dict[str, Column]:
    """Breakouts, each side only until the other comes."""
    up, down = (f.hold(x) for x in shifted_break(f, n, 1).values())
    return {"first_up": f.exrem(up, down), "first_down": f.exrem(down, up)}
