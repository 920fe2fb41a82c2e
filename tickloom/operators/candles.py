"""Candlestick vocabulary and patterns: boolean columns over lags that are computed once."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import recur as k
from tickloom.functions.frame import Frame
from tickloom.operators.scan import scan

div = F.try_divide


class Candle:
    """One bar's parts, ``k`` bars back."""

    def __init__(self, f: Frame, k: int):
        self.o, self.h, self.l, self.c = (F.col(x) if not k else f.hold(f.ref(x, -k)) for x in ("open", "high", "low", "close"))
        self.top, self.low_body = F.greatest(self.o, self.c), F.least(self.o, self.c)
        self.white, self.black = self.c > self.o, self.c < self.o
        self.body, self.span = F.abs(self.c - self.o), self.h - self.l
        self.upper, self.lower = self.h - self.top, self.low_body - self.l
        self.mid = (self.o + self.c) / 2
        self.small, self.large = self.body <= 0.0025 * self.o, self.body >= 0.01 * self.o
        self.doji = self.body <= 0.05 * self.span
        self.long = self.body >= 0.6 * self.span


def near(a: Column, b: Column, pct: float = 0.25) -> Column:
    return F.abs(a - b) <= F.abs(b) * pct / 100


def all_of(*parts: Column) -> Column:
    return reduce(lambda a, b: a & b, parts)


#: A small body is below a quarter of a percent, a large one above one percent.
SMALL_BODY, LARGE_BODY = 0.0025, 0.01


def said(hits: dict[str, Column]) -> dict[str, Column]:
    """A test with a missing value does not hold."""
    return {n: F.coalesce(x, F.lit(False)) for n, x in hits.items()}


def lags(f: Frame, bars: int = 2) -> dict[str, Column]:
    """Open, high, low and close 1 to ``bars`` bars back, added at once."""
    return f.hold_all({f"{x[0]}{i}": F.lag(x, i).over(f.w) for i in range(1, bars + 1) for x in ("open", "high", "low", "close")})


def bodies(o: Column, h: Column, l: Column, c: Column) -> dict[str, Column]:
    """Colour, size and shadows of a candle, in shares of its price; a level candle is white here."""
    white, black = c >= o, o > c
    top, foot = F.greatest(o, c), F.least(o, c)
    return {
        "white": white, "black": black, "small_body": foot >= top * (1 - SMALL_BODY), "large_body": (white & (c >= o * (1 + LARGE_BODY))) | (black & (c <= o * (1 - LARGE_BODY))),
        "small_upper": h <= top * (1 + SMALL_BODY), "small_lower": l >= foot * (1 - SMALL_BODY), "large_upper": h >= top * (1 + LARGE_BODY), "large_lower": l <= foot * (1 - LARGE_BODY),
    }


def vocabulary(f: Frame) -> dict[str, Column]:
    """Bodies, shadows, gaps and context of the current bar."""
    x, b = [F.col(n) for n in ("open", "high", "low", "close")], lags(f)
    o, h, l, c = x
    now, was = bodies(*x), bodies(*(b[n] for n in ("o1", "h1", "l1", "c1")))
    body, body1 = F.abs(o - c), F.abs(b["o1"] - b["c1"])
    five = f.hold_all({"high": f.hhv("high", 5), "low": f.llv("low", 5), "gap_up": f.gap_up(), "gap_down": f.gap_down()})
    # The body lies beyond the one before: which ends are compared depends on both colours.
    above = F.when(was["black"] & now["white"], o > b["o1"]).when(was["black"] & now["black"], c > b["o1"]).when(was["white"] & now["white"], o > b["c1"]).when(was["white"] & now["black"], c > b["c1"])
    under = F.when(was["black"] & now["white"], c < b["c1"]).when(was["black"] & now["black"], o < b["c1"]).when(was["white"] & now["white"], c < b["o1"]).when(was["white"] & now["black"], o < b["o1"])
    doji = lambda o, h, l, c: (F.abs(c - o) <= c * SMALL_BODY) | (F.abs(o - c) <= (h - l) * 0.1)
    return said({
        **now, "medium_body": ~now["large_body"] & ~now["small_body"], "identical_bodies": F.abs(body1 - body) < body * SMALL_BODY, "body_gap_up": above, "body_gap_down": under,
        "high_today": five["high"] == h, "high_yesterday": five["high"] == b["h1"], "low_today": five["low"] == l, "low_yesterday": five["low"] == b["l1"], "doji_today": doji(*x), "doji_yesterday": doji(b["o1"], b["h1"], b["l1"], b["c1"]),
        "gap_up": five["gap_up"], "gap_down": five["gap_down"], "big_gap_up": l > 1.01 * b["h1"], "big_gap_down": h < 0.99 * b["l1"], "huge_gap_up": l > 1.02 * b["h1"], "huge_gap_down": h < 0.98 * b["l1"],
        "double_gap_up": five["gap_up"] & F.lag(five["gap_up"]).over(f.w), "double_gap_down": five["gap_down"] & F.lag(five["gap_down"]).over(f.w),
    })


def single(f: Frame) -> dict[str, Column]:
    """Patterns of one bar."""
    o, h, l, c = (F.col(n) for n in ("open", "high", "low", "close"))
    span, up = h - l, c > o
    share = lambda part: part / (0.001 + h - l)
    return said({
        "near_doji": F.abs(o - c) <= span * 0.1, "long_black": (o > c) & (share(o - c) > 0.6), "small_black": (o > c) & (span > 3 * (o - c)), "long_white": up & (share(c - o) > 0.6), "small_white": up & (span > 3 * (c - o)),
        "marubozu_black": all_of(o > c, h == o, c == l), "marubozu_white": all_of(up, h == c, o == l), "closing_marubozu_black": (o > c) & (c == l), "closing_marubozu_white": up & (c == h), "opening_marubozu_black": (o > c) & (o == h), "opening_marubozu_white": up & (o == l),
        "hanging_man": all_of(span > 4 * (o - c), share(c - l) >= 0.75, share(o - l) >= 0.75), "hammer": all_of(span > 3 * (o - c), share(c - l) > 0.6, share(o - l) > 0.6), "inverted_hammer": all_of(span > 3 * (o - c), share(h - c) > 0.6, share(h - o) > 0.6), "shooting_star": all_of(span > 4 * (o - c), share(h - c) >= 0.75, share(h - o) >= 0.75),
        "spinning_top_black": all_of(o > c, span > 3 * (o - c), share(h - o) < 0.4, share(c - l) < 0.4), "spinning_top_white": all_of(up, span > 3 * (c - o), share(h - c) < 0.4, share(o - l) < 0.4), "doji": o == c,
    })


def simple(f: Frame) -> dict[str, Column]:
    """Patterns of two and three bars, by open, close and range alone."""
    o, h, l, c = (F.col(n) for n in ("open", "high", "low", "close"))
    b = lags(f)
    o1, h1, l1, c1, o2, h2, l2, c2 = (b[n] for n in ("o1", "h1", "l1", "c1", "o2", "h2", "l2", "c2"))
    v = f.hold_all({n: x for n, x in vocabulary(f).items() if n in ("large_body", "white", "black", "small_body", "body_gap_up", "body_gap_down", "high_today", "high_yesterday", "low_yesterday")} | {"ma13": f.ma("close", 13), "low8": f.llv("low", 8), "low2": f.llv("low", 2)})
    was = f.hold_all({f"{n}{i}": F.lag(v[n], i).over(f.w) for n in ("large_body", "white", "black", "body_gap_up", "body_gap_down") for i in (1, 2)} | {"ma13": F.lag(v["ma13"], 4).over(f.w)})
    up, up1, up2, down, down1, down2 = c > o, c1 > o1, c2 > o2, o > c, o1 > c1, o2 > c2
    thin = lambda part, span: div(part, span) < 0.2
    return said({
        "bear_abandoned_baby": all_of(c1 == o1, up2, down, l1 > h2, l1 > h), "evening_doji_star": all_of(up2, div(c2 - o2, 0.001 + h2 - l2) > 0.6, c2 < o1, up1, h1 - l1 > 3 * (c1 - o1), down, o < o1), "dark_cloud": all_of(c1 > o1 * 1.01, down, o > h1, c > o1, (c1 + o1) / 2 > c, v["ma13"] - was["ma13"] > 0),
        "bear_engulfing": all_of(up1, down, o >= c1, o1 >= c, o - c > c1 - o1), "three_outside_down": all_of(up2, down1, o1 >= c2, o2 >= c1, o1 - c1 > c2 - o2, down, c < c1), "bull_abandoned_baby": all_of(c1 == o1, down2, up, l2 > h1, l > h1),
        "morning_doji_star": all_of(down2, div(o2 - c2, 0.001 + h2 - l2) > 0.6, c2 > o1, down1, h1 - l1 > 3 * (c1 - o1), up, o > o1), "bull_engulfing": all_of(down1, up, c >= o1, c1 >= o, c - o > o1 - c1), "three_outside_up": all_of(down2, up1, c1 >= o2, c2 >= o1, c1 - o1 > o2 - c2, up, c > c1),
        "bull_harami": all_of(down1, up, c <= o1, c1 <= o, c - o < o1 - c1), "three_inside_up": all_of(down2, up1, c1 <= o2, c2 <= o1, c1 - o1 < o2 - c2, up, c > c1, o > o1), "piercing_line": all_of(c1 < o1, (o1 + c1) / 2 < c, o < c, o < c1, c < o1, (c - o) / (0.001 + h - l) > 0.6),
        "bear_harami": all_of(up1, down, o <= c1, o1 <= c, o - c < c1 - o1), "three_inside_down": all_of(up2, down1, o1 <= c2, o2 <= c1, o1 - c1 < c2 - o2, down, c < c1, o < o1),
        "three_white_soldiers": all_of(c > o * 1.01, c1 > o1 * 1.01, c2 > o2 * 1.01, c > c1, c1 > c2, o < c1, o > o1, o1 < c2, o1 > o2, thin(h - c, h - l), thin(h1 - c1, h1 - l1), thin(h2 - c2, h2 - l2)), "three_black_crows": all_of(o > c * 1.01, o1 > c1 * 1.01, o2 > c2 * 1.01, c < c1, c1 < c2, o > c1, o < o1, o1 > c2, o1 < o2, thin(c - l, h - l), thin(c1 - l1, h1 - l1), thin(c2 - l2, h2 - l2)),
        "evening_star": all_of(was["large_body2"], was["white2"], was["body_gap_up1"], ~was["large_body1"], v["black"], ~v["small_body"], v["high_today"] | v["high_yesterday"]), "morning_star": all_of(was["large_body2"], was["black2"], was["body_gap_down1"], v["white"], v["large_body"], c > c2, v["low_yesterday"]),
        "matching_low": all_of(v["low8"] == v["low2"], c1 <= o1 * 0.99, F.abs(c - c1) <= c * SMALL_BODY, o > c1, o <= h - (h - l) * 0.5),
    })


def flags(bars: k.Bars) -> dict[str, np.ndarray]:
    """``vocabulary``, ``single`` and ``simple`` as arrays; a comparison with a missing value does not hold."""
    o, h, l, c = bars.o, bars.h, bars.l, bars.c
    (o1, h1, l1, c1), (o2, h2, l2, c2) = ([k.ref(x, -i) for x in (o, h, l, c)] for i in (1, 2))
    before = lambda held, i=1: np.concatenate((np.zeros(min(i, bars.n), bool), held[: max(0, bars.n - i)]))
    every = lambda *parts: reduce(np.logical_and, parts)
    white, black, known = c >= o, o > c, ~(np.isnan(o) | np.isnan(c))
    top, foot = np.maximum(o, c), np.minimum(o, c)
    small, large = foot >= top * (1 - SMALL_BODY), (white & (c >= o * (1 + LARGE_BODY))) | (black & (c <= o * (1 - LARGE_BODY)))
    white1, black1, body, body1 = before(white), before(black), np.abs(o - c), np.abs(o1 - c1)
    above = (black1 & white & (o > o1)) | (black1 & black & (c > o1)) | (white1 & white & (o > c1)) | (white1 & black & (c > c1))
    under = (black1 & white & (c < c1)) | (black1 & black & (o < c1)) | (white1 & white & (c < o1)) | (white1 & black & (o < o1))
    high5, low5, ma13 = k.hhv(h, 5), k.llv(l, 5), k.ma(c, 13)
    gap_up, gap_down = l > h1, h < l1
    high_today, high_yesterday, low_yesterday = high5 == h, high5 == h1, low5 == l1
    doji = lambda o, h, l, c: (np.abs(c - o) <= c * SMALL_BODY) | (np.abs(o - c) <= (h - l) * 0.1)
    words = {
        "white": white, "black": black, "small_body": small, "large_body": large, "small_upper": h <= top * (1 + SMALL_BODY), "small_lower": l >= foot * (1 - SMALL_BODY), "large_upper": h >= top * (1 + LARGE_BODY), "large_lower": l <= foot * (1 - LARGE_BODY),
        "medium_body": known & ~large & ~small, "identical_bodies": np.abs(body1 - body) < body * SMALL_BODY, "body_gap_up": above, "body_gap_down": under,
        "high_today": high_today, "high_yesterday": high_yesterday, "low_today": low5 == l, "low_yesterday": low_yesterday, "doji_today": doji(o, h, l, c), "doji_yesterday": doji(o1, h1, l1, c1),
        "gap_up": gap_up, "gap_down": gap_down, "big_gap_up": l > 1.01 * h1, "big_gap_down": h < 0.99 * l1, "huge_gap_up": l > 1.02 * h1, "huge_gap_down": h < 0.98 * l1, "double_gap_up": gap_up & before(gap_up), "double_gap_down": gap_down & before(gap_down),
    }
    span, up, down, up1, down1, up2, down2 = h - l, c > o, black, c1 > o1, o1 > c1, c2 > o2, o2 > c2
    share = lambda part: part / (0.001 + h - l)
    one = {
        "near_doji": body <= span * 0.1, "long_black": down & (share(o - c) > 0.6), "small_black": down & (span > 3 * (o - c)), "long_white": up & (share(c - o) > 0.6), "small_white": up & (span > 3 * (c - o)),
        "marubozu_black": every(down, h == o, c == l), "marubozu_white": every(up, h == c, o == l), "closing_marubozu_black": down & (c == l), "closing_marubozu_white": up & (c == h), "opening_marubozu_black": down & (o == h), "opening_marubozu_white": up & (o == l),
        "hanging_man": every(span > 4 * (o - c), share(c - l) >= 0.75, share(o - l) >= 0.75), "hammer": every(span > 3 * (o - c), share(c - l) > 0.6, share(o - l) > 0.6), "inverted_hammer": every(span > 3 * (o - c), share(h - c) > 0.6, share(h - o) > 0.6), "shooting_star": every(span > 4 * (o - c), share(h - c) >= 0.75, share(h - o) >= 0.75),
        "spinning_top_black": every(down, span > 3 * (o - c), share(h - o) < 0.4, share(c - l) < 0.4), "spinning_top_white": every(up, span > 3 * (c - o), share(h - c) < 0.4, share(o - l) < 0.4), "doji": o == c,
    }
    thin = lambda part, span: k.div(part, span) < 0.2
    more = {
        "bear_abandoned_baby": every(c1 == o1, up2, down, l1 > h2, l1 > h), "evening_doji_star": every(up2, k.div(c2 - o2, 0.001 + h2 - l2) > 0.6, c2 < o1, up1, h1 - l1 > 3 * (c1 - o1), down, o < o1), "dark_cloud": every(c1 > o1 * 1.01, down, o > h1, c > o1, (c1 + o1) / 2 > c, ma13 - k.ref(ma13, -4) > 0),
        "bear_engulfing": every(up1, down, o >= c1, o1 >= c, o - c > c1 - o1), "three_outside_down": every(up2, down1, o1 >= c2, o2 >= c1, o1 - c1 > c2 - o2, down, c < c1), "bull_abandoned_baby": every(c1 == o1, down2, up, l2 > h1, l > h1),
        "morning_doji_star": every(down2, k.div(o2 - c2, 0.001 + h2 - l2) > 0.6, c2 > o1, down1, h1 - l1 > 3 * (c1 - o1), up, o > o1), "bull_engulfing": every(down1, up, c >= o1, c1 >= o, c - o > o1 - c1), "three_outside_up": every(down2, up1, c1 >= o2, c2 >= o1, c1 - o1 > o2 - c2, up, c > c1),
        "bull_harami": every(down1, up, c <= o1, c1 <= o, c - o < o1 - c1), "three_inside_up": every(down2, up1, c1 <= o2, c2 <= o1, c1 - o1 < o2 - c2, up, c > c1, o > o1), "piercing_line": every(c1 < o1, (o1 + c1) / 2 < c, o < c, o < c1, c < o1, (c - o) / (0.001 + h - l) > 0.6),
        "bear_harami": every(up1, down, o <= c1, o1 <= c, o - c < c1 - o1), "three_inside_down": every(up2, down1, o1 <= c2, o2 <= c1, o1 - c1 < c2 - o2, down, c < c1, o < o1),
        "three_white_soldiers": every(c > o * 1.01, c1 > o1 * 1.01, c2 > o2 * 1.01, c > c1, c1 > c2, o < c1, o > o1, o1 < c2, o1 > o2, thin(h - c, h - l), thin(h1 - c1, h1 - l1), thin(h2 - c2, h2 - l2)), "three_black_crows": every(o > c * 1.01, o1 > c1 * 1.01, o2 > c2 * 1.01, c < c1, c1 < c2, o > c1, o < o1, o1 > c2, o1 < o2, thin(c - l, h - l), thin(c1 - l1, h1 - l1), thin(c2 - l2, h2 - l2)),
        "evening_star": every(before(large, 2), before(white, 2), before(above), before(known & ~large), black, ~small, high_today | high_yesterday), "morning_star": every(before(large, 2), before(black, 2), before(under), white, large, c > c2, low_yesterday),
        "matching_low": every(k.llv(l, 8) == k.llv(l, 2), c1 <= o1 * 0.99, np.abs(c - c1) <= c * SMALL_BODY, o > c1, o <= h - (h - l) * 0.5),
    }
    return words | one | more


#: All flags by name, and how many of them are the bits of one scanned column: fewer than a double holds exactly.
FLAGS, BITS = tuple(flags(k.Bars(pa.table({x: [1.0] for x in ("open", "high", "low", "close")})))), 32


def scanned_flags(bars: DataFrame) -> tuple[Frame, dict[str, Column]]:
    """A frame of ticker and ts, and the 0 or 1 of each flag in it: a scan packs them, so neither windows nor wide rows are needed."""
    packed = lambda b, at: sum(b.once(flags)[n] * 2.0**i for i, n in enumerate(FLAGS[at : at + BITS]))
    steps = {f"_bits{at}": (lambda b, at=at: packed(b, at)) for at in range(0, len(FLAGS), BITS)}
    f = Frame(scan(bars.select("ticker", "ts", "open", "high", "low", "close"), steps, keep=("ticker", "ts")))
    return f, {n: F.shiftright(F.col(f"_bits{i - i % BITS}").cast("long"), i % BITS).bitwiseAND(F.lit(1).cast("long")) for i, n in enumerate(FLAGS)}


#: The labels of a candle, a price move and a pair, the first that holds.
CANDLE_LABELS = {
    "hanging_man": "Hanging Man", "shooting_star": "Shooting Star", "dark_cloud": "Dark Cloud Cover", "bear_engulfing": "Bearish Engulfing", "bear_harami": "Bearish Harami", "evening_star": "Evening Star", "hammer": "Hammer", "inverted_hammer": "Inverted Hammer", "piercing_line": "Piercing Line",
    "bull_engulfing": "Bullish Engulfing", "bull_harami": "Bullish Harami", "morning_star": "Morning Star", "near_doji": "Near Doji", "doji": "Doji", "matching_low": "MATCHING LOW",
}
PRICE_LABELS = {"gap_up": "Gap Up", "gap_down": "Gap Down", "big_gap_up": "Big Gap Up", "big_gap_down": "Big Gap Down", "huge_gap_up": "Huge Gap Up", "huge_gap_down": "Huge Gap Down", "double_gap_up": "Double Gap Up", "double_gap_down": "DoubleGapDown"}


def tweezers(f: Frame) -> dict[str, Column]:
    b, v = lags(f), f.hold_all({n: x for n, x in vocabulary(f).items() if n in ("high_today", "high_yesterday", "low_today", "low_yesterday")})
    o, h, l, c = (F.col(n) for n in ("open", "high", "low", "close"))
    close_by = lambda x: F.abs(l - x) / l < SMALL_BODY
    return said({"tweezer_top": all_of(F.abs(h - b["h1"]) <= h * SMALL_BODY, o > c, b["c1"] > b["o1"], v["high_today"] | v["high_yesterday"]), "tweezer_bottom": all_of(close_by(b["l1"]) | F.coalesce(close_by(b["l2"]), F.lit(False)), o < c, b["o1"] > b["c1"], v["low_today"] | v["low_yesterday"])})


def labels(f: Frame) -> dict[str, Column]:
    """The candle, price and tweezer labels; "Zilch" where none holds."""
    hits = f.hold_all({**single(f), **simple(f)})
    moves, pairs = vocabulary(f), tweezers(f)
    named = lambda hits, names: first_label({names[n]: hits[n] for n in names}, "Zilch")
    return {"candle": named(hits, CANDLE_LABELS), "price_move": named(moves, PRICE_LABELS), "pair": named(pairs, {"tweezer_top": "Tweezer Top", "tweezer_bottom": "Tweezer Bottom"})}


def bullish(f: Frame) -> dict[str, Column]:
    """Patterns that end a fall or continue a rise, on their last bar."""
    x, y, z, u, v = (Candle(f, k) for k in range(5))
    return {
        "bull_abandoned_baby": all_of(z.black, y.doji, y.h < z.l, x.white, x.l > y.h), "bull_belt_hold": all_of(x.white, x.long, x.lower <= 0.02 * x.span, y.black), "bull_breakaway": all_of(v.black, u.black, u.top < v.low_body, z.c < u.c, y.c < z.c, x.white, x.c > u.top),
        "bull_concealing_swallow": all_of(u.black, z.black, y.black, x.black, y.o < z.c, y.upper > 0, x.o > y.h, x.c < y.l), "bull_doji_star": all_of(y.black, y.large, x.doji, x.top < y.low_body), "bull_engulfing": all_of(y.black, x.white, x.o <= y.c, x.c >= y.o, x.body > y.body),
        "bull_harami": all_of(y.black, y.large, x.white, x.top < y.o, x.low_body > y.c), "bull_harami_cross": all_of(y.black, y.large, x.doji, x.top < y.o, x.low_body > y.c), "bull_homing_pigeon": all_of(y.black, x.black, x.o < y.o, x.c > y.c), "bull_meeting_lines": all_of(y.black, x.white, near(x.c, y.c), x.o < y.c),
        "morning_doji_star": all_of(z.black, z.large, y.doji, y.top < z.low_body, x.white, x.c > z.mid), "morning_star": all_of(z.black, z.large, y.small, y.top < z.low_body, x.white, x.c > z.mid), "piercing_line": all_of(y.black, y.large, x.white, x.o < y.l, x.c > y.mid, x.c < y.o),
        "stick_sandwich": all_of(z.black, y.white, x.black, y.c > z.c, near(x.c, z.c)), "three_inside_up": all_of(z.black, z.large, y.white, y.top < z.o, y.low_body > z.c, x.white, x.c > z.o), "three_outside_up": all_of(z.black, y.white, y.o <= z.c, y.c >= z.o, x.white, x.c > y.c),
        "three_stars_south": all_of(z.black, z.lower > z.body, y.black, y.l > z.l, y.body < z.body, x.black, x.upper == 0, x.lower == 0, x.h < y.h), "bull_tri_star": all_of(z.doji, y.doji, x.doji, y.top < z.low_body, x.low_body > y.top), "three_river": all_of(z.black, z.large, y.black, y.l < z.l, y.c > z.c, x.white, x.small, x.c < y.c),
        "mat_hold": all_of(v.white, v.large, u.low_body > v.c, z.c < u.top, y.c < z.top, y.l > v.o, x.white, x.c > u.h), "rising_three": all_of(v.white, v.large, u.black, z.black, y.black, y.l > v.l, u.h < v.h, x.white, x.c > v.c), "bull_separating_lines": all_of(y.black, x.white, near(x.o, y.o), x.large),
        "bull_side_by_side": all_of(z.white, y.white, y.low_body > z.top, x.white, near(x.o, y.o), near(x.body, y.body, 20)), "three_white_soldiers": all_of(z.white, y.white, x.white, y.c > z.c, x.c > y.c, y.o > z.o, y.o < z.c, x.o > y.o, x.o < y.c), "upside_gap_three": all_of(z.white, y.white, y.low_body > z.top, x.black, x.o < y.c, x.o > y.o, x.c < z.c),
        "bull_three_line_strike": all_of(u.white, z.white, y.white, z.c > u.c, y.c > z.c, x.black, x.o > y.c, x.c < u.o), "tweezer_bottom": all_of(near(x.l, y.l, 0.1), y.black, x.white), "upside_tasuki": all_of(z.white, y.white, y.low_body > z.top, x.black, x.o > y.o, x.o < y.c, x.c < y.o, x.c > z.c), "matching_low": all_of(y.black, x.black, near(x.c, y.c, 0.1)),
    }


def bearish(f: Frame) -> dict[str, Column]:
    """Patterns that end a rise or continue a fall, on their last bar."""
    x, y, z, u, v = (Candle(f, k) for k in range(5))
    return {
        "bear_abandoned_baby": all_of(z.white, y.doji, y.l > z.h, x.black, x.h < y.l), "advance_block": all_of(z.white, y.white, x.white, y.c > z.c, x.c > y.c, y.body < z.body, x.body < y.body, x.upper > y.upper), "bear_belt_hold": all_of(x.black, x.long, x.upper <= 0.02 * x.span, y.white),
        "bear_breakaway": all_of(v.white, u.white, u.low_body > v.top, z.c > u.c, y.c > z.c, x.black, x.c < u.low_body), "dark_cloud": all_of(y.white, y.large, x.black, x.o > y.h, x.c < y.mid, x.c > y.o), "deliberation": all_of(z.white, z.large, y.white, y.large, y.c > z.c, x.white, x.small, x.o >= y.c),
        "counter_attack": all_of(y.white, x.black, near(x.c, y.c), x.o > y.c), "bear_doji_star": all_of(y.white, y.large, x.doji, x.low_body > y.top), "bear_engulfing": all_of(y.white, x.black, x.o >= y.c, x.c <= y.o, x.body > y.body), "evening_doji_star": all_of(z.white, z.large, y.doji, y.low_body > z.top, x.black, x.c < z.mid),
        "evening_star": all_of(z.white, z.large, y.small, y.low_body > z.top, x.black, x.c < z.mid), "bear_harami": all_of(y.white, y.large, x.black, x.top < y.c, x.low_body > y.o), "bear_harami_cross": all_of(y.white, y.large, x.doji, x.top < y.c, x.low_body > y.o), "identical_crows": all_of(z.black, y.black, x.black, near(y.o, z.c), near(x.o, y.c)),
        "kicking": all_of(y.white, y.upper == 0, y.lower == 0, x.black, x.upper == 0, x.lower == 0, x.o < y.o), "gap_shooting_star": all_of(x.low_body > y.top, x.upper >= 2 * x.body, x.lower <= 0.1 * x.span), "three_inside_down": all_of(z.white, z.large, y.black, y.top < z.c, y.low_body > z.o, x.black, x.c < z.o),
        "three_outside_down": all_of(z.white, y.black, y.o >= z.c, y.c <= z.o, x.black, x.c < y.c), "bear_tri_star": all_of(z.doji, y.doji, x.doji, y.low_body > z.top, x.top < y.low_body), "two_crows": all_of(z.white, z.large, y.black, y.low_body > z.top, x.black, x.o < y.o, x.o > y.c, x.c < z.c, x.c > z.o),
        "upside_gap_two_crows": all_of(z.white, y.black, y.low_body > z.top, x.black, x.o > y.o, x.c < y.c, x.c > z.c), "downside_gap_three": all_of(z.black, y.black, y.top < z.low_body, x.white, x.o > y.c, x.o < y.o, x.c > z.c), "downside_tasuki": all_of(z.black, y.black, y.top < z.low_body, x.white, x.o < y.o, x.o > y.c, x.c > y.o, x.c < z.c),
        "falling_three": all_of(v.black, v.large, u.white, z.white, y.white, y.h < v.h, u.l > v.l, x.black, x.c < v.c), "in_neck": all_of(y.black, y.large, x.white, x.o < y.l, x.c >= y.c, x.c <= y.c + 0.1 * y.body), "on_neck": all_of(y.black, y.large, x.white, x.o < y.l, near(x.c, y.l)), "thrusting": all_of(y.black, y.large, x.white, x.o < y.l, x.c > y.c + 0.1 * y.body, x.c < y.mid),
        "bear_separating_lines": all_of(y.white, x.black, near(x.o, y.o), x.large), "bear_side_by_side": all_of(z.black, y.white, y.top < z.low_body, x.white, near(x.o, y.o), near(x.body, y.body, 20)), "three_black_crows": all_of(z.black, y.black, x.black, y.c < z.c, x.c < y.c, y.o < z.o, y.o > z.c, x.o < y.o, x.o > y.c),
        "bear_three_line_strike": all_of(u.black, z.black, y.black, z.c < u.c, y.c < z.c, x.white, x.o < y.c, x.c > u.o), "tweezer_top": all_of(near(x.h, y.h, 0.1), y.white, x.black),
    }


def reversals(f: Frame) -> dict[str, Column]:
    """Six reversal rules, each for buying and selling."""
    x, y, z = (Candle(f, k) for k in range(3))
    return {
        "closing_price_buy": all_of(x.l < y.l, x.c > y.c), "closing_price_sell": all_of(x.h > y.h, x.c < y.c), "hook_buy": all_of(x.o <= x.l + 0.2 * x.span, x.c >= x.h - 0.2 * x.span, x.l > y.l, x.h < y.h), "hook_sell": all_of(x.o >= x.h - 0.2 * x.span, x.c <= x.l + 0.2 * x.span, x.l > y.l, x.h < y.h),
        "island_buy": all_of(y.h < z.l, x.l > y.h), "island_sell": all_of(y.l > z.h, x.h < y.l), "key_buy": all_of(x.o < y.c, x.l < y.l, x.c > y.h), "key_sell": all_of(x.o > y.c, x.h > y.h, x.c < y.l), "open_close_buy": all_of(near(x.o, x.l, 0.1), x.c > y.h), "open_close_sell": all_of(near(x.o, x.h, 0.1), x.c < y.l),
        "pivot_buy": all_of(y.l < z.l, x.l > y.l, x.c > y.h), "pivot_sell": all_of(y.h > z.h, x.h < y.h, x.c < y.l),
    }


def pin_bar(f: Frame) -> dict[str, Column]:
    x, y = Candle(f, 0), Candle(f, 1)
    high, low = f.hold(f.hhv("high", 10)), f.hold(f.llv("low", 10))
    return {"pin_bull": all_of(x.lower >= 0.66 * x.span, x.body <= 0.33 * x.span, x.l == low, x.l < y.l, x.c > y.l), "pin_bear": all_of(x.upper >= 0.66 * x.span, x.body <= 0.33 * x.span, x.h == high, x.h > y.h, x.c < y.h)}


def base_runs(f: Frame, rate: float = 0.5) -> dict[str, Column]:
    """Whether a bar is a base (small body), rally or decline candle, and the length of the run of bases."""
    x = Candle(f, 0)
    base = f.hold(F.coalesce(x.body <= rate * x.span, F.lit(False)))
    return {"base_candle": base, "rally_candle": ~base & x.white, "decline_candle": ~base & x.black, "base_run": f.run_length(base)}


def first_label(patterns: dict[str, Column], otherwise: str = "none") -> Column:
    out = F.lit(None).cast("string")
    for name, hit in reversed(patterns.items()):
        out = F.when(hit, F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit(otherwise))


def all_labels(patterns: dict[str, Column], sep: str = ",") -> Column:
    return F.concat_ws(sep, *[F.when(hit, F.lit(name)) for name, hit in patterns.items()])


def hit_rates(f: Frame, patterns: dict[str, Column], ahead: int = 3):
    """Per ticker and pattern: occurrences, and how many closes rose or fell ``ahead`` bars later (looks ahead); 70 percent decides."""
    later = f.hold(f.ref("close", ahead) - F.col("close"))
    hits = F.array(*[F.when(hit, F.lit(name)) for name, hit in patterns.items()])
    rows = f.select(f.by, F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("pattern"), later.alias("later"))
    out = rows.groupBy(f.by, "pattern").agg(F.count("*").alias("n"), F.count_if(F.col("later") > 0).alias("up"), F.count_if(F.col("later") < 0).alias("down"))
    return out.withColumn("verdict", F.when(F.col("up") >= 0.7 * F.col("n"), "buy").when(F.col("down") >= 0.7 * F.col("n"), "sell").otherwise(""))
