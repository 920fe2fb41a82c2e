"""Volume-price analysis: classes of volume, spread and close, trend states, and the signals of weakness and strength.

Means that are recurrences (spread, move, result) and the random-walk levels come
from one grouped scan; everything else is windows over the same partitioning, a
few levels deep.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import recur as k
from tickloom.functions.frame import Frame, as_column
from tickloom.operators.candles import all_labels, all_of
from tickloom.operators.scan import scan

div = F.try_divide


def random_walk(b: k.Bars, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest rise and fall over spans of ``low`` to ``high`` bars, in mean true ranges times the root of the span."""
    tr = k.true_range(b)
    units = {n: k.ma(tr, n) * n**0.5 for n in range(low, high + 1)}
    up = np.fmax.reduce([k.div(b.h - k.ref(b.l, -(n - 1)), u) for n, u in units.items()])
    down = np.fmax.reduce([k.div(k.ref(b.h, -(n - 1)) - b.l, u) for n, u in units.items()])
    return up, down


STEPS = {
    "avg_spread": lambda b: k.ema(b.h - b.l, 40), "avg_move": lambda b: k.ema(np.abs(b.c - b.o), 40), "up_now": lambda b: b.once(random_walk, 2, 7)[0], "down_now": lambda b: b.once(random_walk, 2, 7)[1], "up_long": lambda b: b.once(random_walk, 8, 40)[0], "down_long": lambda b: b.once(random_walk, 8, 40)[1],
    "mean_spread": lambda b: k.wilders(b.h - b.l, 40), "mean_result": lambda b: k.wilders(np.abs(b.c - k.ref(b.c, -1)), 40),
    "vol_avg": lambda b: k.ma(b.v, 30), "vol_mean": lambda b: k.stdev(k.ma(b.v, 30), 30), "high5": lambda b: k.hhv(b.h, 5), "low5": lambda b: k.llv(b.l, 5), "high10": lambda b: k.hhv(b.h, 10), "vol60": lambda b: k.hhv(b.v, 60),
    **{f"slope_{n}": (lambda b, n=n: k.slope(k.ma(b.c, 5), n)) for n in (40, 10, 3)},
}
#: What the classes alone need.
CLASS_STEPS = {n: STEPS[n] for n in ("avg_spread", "vol_avg", "vol_mean")}


def force_lines(b: k.Bars, n: int, over: int) -> tuple[np.ndarray, ...]:
    """The columns of ``forces`` as arrays."""
    span, moved = b.h - b.l, np.abs(b.c - k.ref(b.c, -1))
    buy, sell = (k.wma(np.nan_to_num(k.div(b.v * x, span)), n) for x in (b.c - b.l, b.h - b.c))
    top, low = np.fmax(k.hhv(buy, over), k.hhv(sell, over)), np.fmin(k.llv(buy, over), k.llv(sell, over))
    ratios = k.div(span, k.wilders(span, 40)), k.div(b.v, k.wma(b.v, over)), k.div(moved, k.wilders(moved, 40))
    scaled = (100 * (x - k.llv(x, over)) / (k.hhv(x, over) - k.llv(x, over) + 1e-9) for x in ratios)
    return 100 * k.div(buy - low, top - low), 100 * k.div(sell - low, top - low), *scaled


FORCE_STEPS = {x: (lambda b, i=i: b.once(force_lines, 20, 40)[i]) for i, x in enumerate(("buy_force", "sell_force", "spread_norm", "volume_norm", "result_norm"))}


def scanned(bars: DataFrame, only: dict | None = None, **more) -> Frame:
    """A frame of bars with what the sheet takes from a scan (or of it ``only`` some), and any other steps."""
    return Frame(scan(bars, (STEPS if only is None else only) | more))


def said(x: Column) -> Column:
    """A comparison with a missing value does not hold."""
    return F.coalesce(x, F.lit(False))


def close_position() -> Column:
    """Fifth of the bar's spread in which it closes, from the low."""
    s, l = F.col("high") - F.col("low"), F.col("low")
    low_side = lambda share: F.col("close") <= s * share + l
    return F.when(low_side(0.2), 1).when(low_side(0.4), 2).when(low_side(0.6), 3).when(low_side(0.8), 4).otherwise(5)


def class_terms() -> dict[str, Column]:
    """What ``texts`` reads, from a frame of the ``CLASS_STEPS``."""
    return {"v": F.col("volume"), "spread": F.col("high") - F.col("low"), "close_pos": close_position()} | {n: F.col(n) for n in CLASS_STEPS}


def base(f: Frame) -> dict[str, Column]:
    """Classes of the bar, trend states, and the terms that the signals share."""
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    back = f.hold_all({f"{n}{i}": F.lag(x, i).over(f.w) for n, x, most in (("c", c, 5), ("h", h, 1), ("l", l, 1), ("v", v, 2)) for i in range(1, most + 1)})
    held = {"vol_avg": "vol_avg", "vol_mean": "vol_mean", "h5": "high5", "l5": "low5", "h10": "high10", "v60": "vol60"} | {f"trend_{n}": f"slope_{n}" for n in (40, 10, 3)}
    b = {"c": c, "v": v, "spread": h - l, "avg_spread": F.col("avg_spread"), **back, **{n: F.col(x) for n, x in held.items()}}
    s, mean = b["spread"], b["vol_avg"]
    j, j2, k2 = F.col("up_long") - F.col("down_long"), F.col("up_long"), F.col("down_long")
    low_side = lambda share: c <= s * share + l
    terms = {
        "wide": s > 1.5 * b["avg_spread"], "narrow": s < 0.7 * b["avg_spread"], "over_spread": s > b["avg_spread"], "low_volume": (v < b["v1"]) & (v < b["v2"]) & (v < mean), "high_volume": (v > b["v1"]) & (b["v1"] > b["v2"]), "up_bar": c > b["c1"], "down_bar": c < b["c1"], "busy": (v > mean) | said(v > b["v1"]),
        "up_close": c >= s * 0.7 + l, "down_close": low_side(0.3), "above_close": c > s * 0.5 + l, "below_close": c < s * 0.5 + l, "mid_close": (c > s * 0.3 + l) & (c < s * 0.7 + l), "fresh_high": h == b["h5"], "fresh_low": l == b["l5"],
    }
    close_pos = close_position()
    vol_pos = F.when(v > mean * 2, 1).when(v > mean * 1.3, 2).when(v >= mean, 3).when((v < mean) & (v > mean * 0.7), 4).otherwise(5)
    position = F.when(c == l, b["avg_spread"]).otherwise(div(s, c - l + 1e-9))
    states = {"upmajor": F.when(j > 1, 1).when(j < -1, -1).otherwise(0), "upminor": F.when(j2 > 1, 1).otherwise(-1), "dnminor": F.when(k2 > 1, 1).otherwise(-1), "upimd": F.when(F.col("up_now") > 1, 1).otherwise(0), "dnimd": F.when(F.col("down_now") > 1, 1).otherwise(0)}
    b |= f.hold_all({n: said(x) for n, x in terms.items()} | {"close_pos": close_pos, "vol_pos": vol_pos, "position": position, **states, "j": j})
    b |= {f"{n}_1": said(F.lag(b[n]).over(f.w)) for n in ("up_bar", "down_bar", "wide", "down_close")}
    return b


def trend_events(f: Frame, b: dict[str, Column]) -> dict[str, Column]:
    """Bars on which a trend has been switched on or off: the level holds on the bar after it was crossed."""
    out = {}
    for name, level, line, above in (("upmajor_on", b["j"], 1, True), ("upmajor_off", b["j"], 1, False), ("dnmajor_on", b["j"], -1, False), ("dnmajor_off", b["j"], -1, True), ("upminor_on", F.col("up_long"), 1, True), ("upminor_off", F.col("up_long"), 1, False), ("dnminor_on", F.col("down_long"), 1, True), ("dnminor_off", F.col("down_long"), 1, False)):
        one, two = F.lag(level, 1).over(f.w), F.lag(level, 2).over(f.w)
        out[name] = said((level > line) & (one > line) & (two <= line)) if above else said((level < line) & (one < line) & (two >= line))
    return out


def signals(f: Frame, b: dict[str, Column]) -> tuple[dict[str, Column], dict[str, Column]]:
    """Signals of weakness and of strength."""
    h, v, was = F.col("high"), b["v"], lambda x: said(F.lag(x).over(f.w))
    mean, higher, lower = b["vol_avg"], said(F.col("high") > b["h1"]), said(F.col("low") < b["l1"])
    one = f.hold_all({
        "upthrust": all_of(b["wide"], b["down_close"], b["upimd"] == 1, higher),
        "strength_down": all_of(b["vol_pos"] < 4, b["down_bar_1"], b["up_bar"], b["close_pos"] > 3, b["upimd"] <= 0, b["upminor"] < 0),
        "strength_down1": all_of(b["upmajor"] < 0, said(v > mean * 1.5), b["down_bar_1"], b["up_bar"], b["close_pos"] > 3, b["upminor"] < 0, b["upimd"] <= 0),
        "low_test": all_of(b["fresh_low"], b["up_close"], b["low_volume"]),
        "rev_upthrust": all_of(b["upmajor"] < 0, b["up_bar"], b["up_close"], said(v > b["v1"]), said(v > mean), b["wide"], b["down_bar_1"], b["down_close_1"], b["upminor"] < 0),
        "effort_up": all_of(higher, said(F.col("low") > b["l1"]), b["up_bar"], b["up_close"], b["over_spread"], b["vol_pos"] < 4),
        "effort_down": all_of(said(h < b["h1"]), lower, b["down_bar"], said(b["c"] <= b["spread"] * 0.25 + F.col("low")), b["wide"], b["vol_pos"] < 4),
        "pseudo": all_of(b["up_bar_1"], higher, said(b["v1"] > 1.5 * mean), b["down_bar"], b["down_close"]),
    })
    buy1, pseudo = one["strength_down"] | one["strength_down1"], one["pseudo"] & ~one["upthrust"]
    two = f.hold_all({"cond1": was(one["upthrust"]) & b["down_bar"] & ~b["narrow"], "cond2": was(one["upthrust"]) & b["down_bar"] & (b["vol_pos"] == 2), "cond3": one["upthrust"] & (b["vol_pos"] == 1), "pseudo_was": was(pseudo), "buy1_was": was(buy1), "test_was": was(one["low_test"]), "effort_up_was": was(one["effort_up"]), "effort_down_was": was(one["effort_down"])})
    sell1 = two["cond1"] | two["cond2"] | two["cond3"]
    three = f.hold_all({"sell": sell1 & (F.coalesce(F.lag(sell1).over(f.w), F.lit(True)) == F.lit(False))})
    no_demand = all_of(b["up_bar"], b["narrow"], b["low_volume"], b["close_pos"] > 3)
    weak = {
        "up_thrust": one["upthrust"], "new_up_thrust": all_of(b["wide"], b["down_close"], b["fresh_high"], b["high_volume"]), "buying_climax": all_of(b["wide"], b["above_close"], said(v == b["v60"]), b["upmajor"] == 1),
        "up_thrust_minor": all_of(b["wide"], b["close_pos"] <= 2, b["upminor"] > 0, higher, (b["upimd"] > 0) | (b["upmajor"] > 0), b["vol_pos"] < 4), "up_thrust_true": all_of(b["wide"], b["close_pos"] == 1, b["upmajor"] > 0, higher, b["vol_pos"] < 4),
        "up_thrust_cond1": two["cond1"], "up_thrust_cond2": two["cond2"], "up_thrust_cond3": two["cond3"], "sell_cond": three["sell"], "top_reversal": all_of(said(b["v1"] > mean), b["up_bar_1"], b["wide_1"], b["down_bar"], b["down_close"], b["wide"], b["upmajor"] > 0, said(h == b["h10"])),
        "pseudo_up_thrust": pseudo, "pseudo_confirmed": all_of(two["pseudo_was"], b["down_bar"], b["down_close"], ~one["upthrust"]),
        "trend_change": all_of(b["up_bar_1"], b["fresh_high"], b["down_bar"], b["down_close"] | b["mid_close"], said(v > mean), b["upmajor"] > 0, b["upimd"] > 0, ~b["wide"], ~pseudo),
        "no_demand_up": no_demand & (((b["upminor"] == 1) & (b["upimd"] == 1)) | ((b["upminor"] == 1) & (b["upmajor"] == 1))), "no_demand_down": no_demand & ((b["upminor"] == -1) | (b["upimd"] == -1)), "effort_down": one["effort_down"],
        "effort_up_fails": two["effort_up_was"] & (one["upthrust"] | sell1 | (b["down_bar"] & b["over_spread"])),
    }
    strong = {
        "no_supply": all_of(b["down_bar"], b["narrow"], b["low_volume"], b["close_pos"] < 3, ((b["upminor"] < 1) & (b["upimd"] < 1)) | ((b["upminor"] > 0) & (b["upimd"] < 1))), "low_test": one["low_test"],
        "low_test1": all_of(b["fresh_low"], said(v < mean), lower, b["up_close"], b["upminor"] > 0, b["upmajor"] > 0), "low_test2": all_of(two["test_was"], b["up_bar"], b["up_close"]), "strength_down0": one["strength_down"] & (b["upmajor"] < 0), "strength_down": one["strength_down"], "strength_down1": one["strength_down1"],
        "strength_down2": all_of(b["upimd"] <= 0, said(b["v1"] < mean), b["up_bar"], said(b["position"] < 1.35), b["vol_pos"] < 4), "buy_cond": b["up_bar"] & two["buy1_was"], "stopping_volume": all_of(b["fresh_low"], b["up_close"] | b["mid_close"], said(v > 1.5 * mean), b["upmajor"] < 0), "rev_up_thrust": one["rev_upthrust"],
        "effort_up": one["effort_up"], "effort_down_fails": two["effort_down_was"] & ((b["up_bar"] & b["over_spread"]) | one["rev_upthrust"] | buy1), "selling_climax": all_of(b["wide"], b["below_close"], said(v == b["v60"]), b["upmajor"] == -1),
    }
    flagged = ("sell_cond", "effort_up_fails", "effort_down", "no_demand_down", "no_demand_up", "buying_climax"), ("buy_cond", "effort_up", "stopping_volume", "effort_down_fails", "rev_up_thrust", "no_supply", "low_test", "low_test1", "low_test2")
    flag = any_of([weak[n] for n in flagged[0]] + [strong[n] for n in flagged[1]])
    strong["bull_bar"] = all_of(b["busy"], said(b["position"] < 2), b["up_bar"], ~flag)
    weak["bear_bar"] = all_of(b["busy"], b["down_close"], b["down_bar"], b["over_spread"], ~flag)
    return weak, strong


def any_of(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def volume_class(b: dict[str, Column]) -> Column:
    v, m = b["v"], b["vol_avg"]
    return F.when(v > m * 2, "5. Higher").when(v > m * 1.3, "4. High").when(v > m, "3. Average Above").when((v < m) & (v > m * 0.7), "2. Average Less than").when(v < m - b["vol_mean"], "1. Low").otherwise("")


def spread_class(b: dict[str, Column]) -> Column:
    s, m = b["spread"], b["avg_spread"]
    return F.when(s > m * 1.5, "5. Wide").when(s > m, "4. Average Above").when((s < m) & (s >= m * 0.7), "3. Average Below").when(s < m * 0.5, "1. Narrow Very").otherwise("2. Narrow")


def close_class(b: dict[str, Column]) -> Column:
    return F.when(b["close_pos"] == 5, "High").when(b["close_pos"] == 4, "Upper side").when(b["close_pos"] == 3, "Mid").when(b["close_pos"] == 2, "Lower Side").otherwise("Low")


def bands(b: dict[str, Column]) -> dict[str, Column]:
    """The volume mean and the deviation bands around it."""
    return {"volume_mean": b["vol_avg"], **{f"volume_up{n}": b["vol_avg"] + n * b["vol_mean"] for n in (1, 2, 3)}, **{f"volume_down{n}": b["vol_avg"] - n * b["vol_mean"] for n in (1, 2)}}


def effort_and_reversals(f: Frame, b: dict[str, Column]) -> dict[str, Column]:
    """Effort without result, and five two-bar reversals."""
    c1, v, mean = b["c1"], b["v"], b["vol_avg"]
    fell, rose = (said(all_of(*(one(c1, b[f"c{i}"]) for i in (2, 3, 4, 5)))) for one in (lambda x, y: x < y, lambda x, y: x > y))
    lower, outside = said(F.col("low") < b["l1"]), said((F.col("low") < b["l1"]) & (F.col("high") > b["h1"]))
    busy, calm = said(v > 1.2 * mean), said(v <= 1.2 * mean)
    return {
        "effort_no_result": said((v > 1.5 * mean) & (F.abs(b["c"] - F.col("open")) < 0.5 * F.col("avg_move"))), "two_bar_up_busy": all_of(fell, outside, busy, b["up_close"]), "two_bar_up_busy_inside": all_of(fell, lower, b["up_bar"], busy, b["up_close"], ~outside), "two_bar_up_calm": all_of(fell, outside, b["up_close"], calm),
        "two_bar_down_busy": all_of(rose, outside, busy, b["down_close"]), "two_bar_down_calm": all_of(rose, outside, b["down_close"], calm),
    }


def composites(b: dict[str, Column], weak: dict[str, Column], strong: dict[str, Column]) -> dict[str, Column]:
    """Whether a bar counts as strong or as weak: its signals, or simply its direction."""
    return {
        "is_strong": any_of([b["up_bar"], *(strong[n] for n in ("strength_down", "strength_down1", "strength_down2", "strength_down0", "bull_bar", "effort_up", "low_test", "low_test1", "low_test2", "rev_up_thrust", "stopping_volume"))]),
        "is_weak": any_of([b["down_bar"], strong["no_supply"], *(weak[n] for n in ("up_thrust", "up_thrust_cond1", "up_thrust_cond2", "up_thrust_cond3", "pseudo_up_thrust", "pseudo_confirmed", "effort_down", "trend_change", "no_demand_down", "bear_bar"))]),
    }


def texts(b: dict[str, Column]) -> dict[str, Column]:
    return {"volume_class": volume_class(b), "spread_class": spread_class(b), "close_class": close_class(b)}


def sheet(f: Frame) -> dict[str, Column]:
    """All of it, for a frame made by ``scanned``."""
    b = base(f)
    weak, strong = signals(f, b)
    return {**texts(b), "weakness": all_labels(weak), "strength": all_labels(strong), **composites(b, weak, strong), **effort_and_reversals(f, b), **{n: b[n] for n in ("upmajor", "upminor", "dnminor", "upimd", "dnimd", "trend_40", "trend_10", "trend_3")}, **trend_events(f, b), **bands(b)}


def forces(f: Frame, n: int = 20, over: int = 40) -> dict[str, Column]:
    """Buying and selling force (weighted means of volume times the distance to the low or high), scaled to their extremes; and spread, volume and result over their means, scaled likewise."""
    span = f.hold(F.col("high") - F.col("low"))
    raw = f.hold_all({"buy": F.coalesce(div(F.col("volume") * (F.col("close") - F.col("low")), span), F.lit(0.0)), "sell": F.coalesce(div(F.col("volume") * (F.col("high") - F.col("close")), span), F.lit(0.0))})
    ratios = f.hold_all({"buy": f.wma(raw["buy"], n), "sell": f.wma(raw["sell"], n), "spread": div(span, F.col("mean_spread")), "volume": div(F.col("volume").cast("double"), f.wma("volume", over)), "result": div(F.abs(F.col("close") - f.ref("close", -1)), F.col("mean_result"))})
    ends = f.hold_all({f"{side}_{name}": of(x, over) for name, x in ratios.items() for side, of in (("top", f.hhv), ("low", f.llv))})
    top, low = F.greatest(ends["top_buy"], ends["top_sell"]), F.least(ends["low_buy"], ends["low_sell"])
    scaled = {f"{name}_norm": 100 * (ratios[name] - ends[f"low_{name}"]) / (ends[f"top_{name}"] - ends[f"low_{name}"] + 1e-9) for name in ("spread", "volume", "result")}
    return {"buy_force": 100 * div(ratios["buy"] - low, top - low), "sell_force": 100 * div(ratios["sell"] - low, top - low), **scaled}


def strength_and_weakness(f: Frame, mean_range) -> dict[str, Column]:
    """Eight signs of strength and eight of weakness, by classes of volume, range and close position.

    ``mean_range`` is the smoothed bar range.  ``sos7`` and ``sow7`` ask for the
    next bar's close and so look ahead.
    """
    v, c, high, low = (F.col(x) for x in ("volume", "close", "high", "low"))
    span, mean = f.hold(high - low), as_column(mean_range)
    h = f.hold_all({
        "v": f.ma("volume", 30), "v3": f.hhv("volume", 3), "v5": f.hhv("volume", 5),
        **{f"h{n}": f.hhv("high", n) for n in (5, 20, 100)}, **{f"l{n}": f.llv("low", n) for n in (5, 20, 100)},
    })
    b = f.hold_all({n: f.ref(x, -1) for n, x in h.items() if n != "v"} | {
        "c": f.ref("close", -1), "high": f.ref("high", -1), "low": f.ref("low", -1), "v1": f.ref("volume", -1), "v2": f.ref("volume", -2),
        "s1": f.ref(span, -1), "s2": f.ref(span, -2), "next": f.ref("close", 1),
    })
    ultra_volume, high_volume = v > 2 * h["v"], (v > 1.1 * h["v"]) & (v < 2 * h["v"])
    ultra_wide, wide = span > 2 * mean, (span > 1.33 * mean) & (span < 2 * mean)
    normal, small, tiny = (span > 0.67 * mean) & (span < 1.33 * mean), span < 0.67 * mean, span < 0.5 * mean
    upper, lower = c > high - span / 3, c < low + span / 3
    middle = (c < high - span / 3) & (c > low + span / 3)
    broad, narrow = ultra_wide | wide, small | tiny
    drying = ((span < b["s1"]) & (span < b["s2"]) | narrow) & (v < b["v1"]) & (v < b["v2"])
    top = {n: high > b[f"h{n}"] for n in (5, 20, 100)}
    bottom = {n: low < b[f"l{n}"] for n in (5, 20, 100)}
    strong = high_volume | (v > b["v5"])
    out = {}
    for name, turn, far, near, edge, other, follow in (
        ("sos", c < b["c"], upper, lower, bottom, low < b["low"], b["next"] > c),
        ("sow", c > b["c"], lower, upper, top, high > b["high"], b["next"] < c),
    ):
        trap = c > b["high"] if name == "sos" else c < b["low"]
        hold_gap = high < b["low"] if name == "sos" else F.lit(True)
        signs = (
            turn & ((v > b["v3"]) & edge[20] | ultra_volume) & broad & (middle | far),
            turn & (high_volume & edge[20] | ultra_volume) & broad & (middle | far),
            turn & (middle | far) & (normal | small) & (edge[20] | ultra_volume),
            turn & ultra_volume & hold_gap & (normal | narrow) & edge[100],
            (broad | (span > mean)) & far & edge[5],
            turn & drying,
            turn & near & (ultra_volume | strong & edge[5]) & follow,
            other & trap & (strong | ultra_volume),
        )
        out |= {f"{name}{i}": F.coalesce(s, F.lit(False)) for i, s in enumerate(signs, 1)}
    return out
