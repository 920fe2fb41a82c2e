"""Indicators that are window expressions.  Each takes a ``Frame`` and gives a column, or a dict of columns."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tickloom.functions import recur
from tickloom.functions.frame import Frame, as_column
from tickloom.operators.scan import scan

div = F.try_divide


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


# -- averages ----------------------------------------------------------------
def double_wma(f: Frame, x, n: int) -> Column:
    w = f.hold(f.wma(x, n))
    return 2 * w - f.wma(w, n)


def hull(f: Frame, x, n: int, last: int | None = None) -> Column:
    return f.wma(f.hold(2 * f.hold(f.wma(x, n // 2)) - f.hold(f.wma(x, n))), last or int(n**0.5))


def distance_from_ma(f: Frame, n: int) -> Column:
    m = f.hold(f.ma("close", n))
    return 100 * div(F.col("close") - m, m)


def nearest_ma(f: Frame, short: int = 20, middle: int = 50, long: int = 200) -> dict[str, Column]:
    """Which of two averages the close is nearer to, 0 if it is below both, and whether it is above the long one."""
    a, b, c = (f.hold(f.ma("close", n)) for n in (short, middle, long))
    close = F.col("close")
    nearest = F.when((close < a) & (close < b), 0).when(F.abs(close - a) <= F.abs(close - b), short).otherwise(middle)
    return {"nearest_ma": F.when(b.isNotNull(), nearest), "above_long": F.when(c.isNotNull(), (close > c).cast("int"))}


# -- oscillators -------------------------------------------------------------
def stoch_k(f: Frame, n: int = 14, smooth: int = 3) -> Column:
    low, high = f.hold(f.llv("low", n)), f.hold(f.hhv("high", n))
    return f.ma(f.hold(100 * div(F.col("close") - low, high - low)), smooth)


def kdj(f: Frame, n: int = 9, k: int = 3, d: int = 3) -> dict[str, Column]:
    fast = f.hold(stoch_k(f, n, k))
    slow = f.hold(f.ma(fast, d))
    return {"kdj_k": fast, "kdj_d": slow, "kdj_j": 3 * fast - 2 * slow}


def cci(f: Frame, n: int = 14) -> Column:
    """Deviation of the typical price from its mean, in 0.015 mean absolute deviations."""
    t = f.hold(typical())
    m = f.hold(f.ma(t, n))
    window = f.hold(F.collect_list(t).over(f.back(n)))
    spread = F.aggregate(window, F.lit(0.0), lambda a, v: a + F.abs(v - m)) / n
    return div(t - m, 0.015 * spread)


def mfi(f: Frame, n: int = 14) -> Column:
    t = f.hold(typical())
    before = f.hold(f.ref(t, -1))
    flow = t * F.col("volume")
    up = f.hold(F.when(before.isNotNull(), F.when(t > before, flow).otherwise(0.0)))
    down = f.hold(F.when(before.isNotNull(), F.when(t < before, flow).otherwise(0.0)))
    gain, loss = f.hold(f.sum(up, n)), f.hold(f.sum(down, n))
    return 100 * div(gain, gain + loss)


def williams_r(f: Frame, n: int = 14) -> Column:
    low, high = f.hold(f.llv("low", n)), f.hold(f.hhv("high", n))
    return -100 * div(high - F.col("close"), high - low)


def ultimate(f: Frame, short: int = 7, middle: int = 14, long: int = 28) -> Column:
    before = f.hold(f.ref("close", -1))
    pressure = f.hold(F.col("close") - F.least("low", F.coalesce(before, F.col("low"))))
    span = f.hold(f.true_range())
    a, b, c = (f.hold(div(f.sum(pressure, n), f.sum(span, n))) for n in (short, middle, long))
    return 100 * (4 * a + 2 * b + c) / 7


def dpo(f: Frame, n: int = 20) -> Column:
    return F.col("close") - f.ref(f.hold(f.ma("close", n)), -(n // 2 + 1))


def kst(f: Frame) -> Column:
    parts = [f.hold(f.ma(f.hold(f.roc("close", gap)), n)) for gap, n in ((10, 10), (15, 10), (20, 10), (30, 15))]
    return sum((w * p for w, p in enumerate(parts, 1)), F.lit(0.0))


def aroon(f: Frame, n: int = 14) -> dict[str, Column]:
    up = f.hold(100.0 * (n - f.hhvbars("high", n + 1)) / n)
    down = f.hold(100.0 * (n - f.llvbars("low", n + 1)) / n)
    return {"aroon_up": up, "aroon_down": down, "aroon_osc": up - down}


def psychological(f: Frame, n: int = 12) -> Column:
    return 100 * f.ma(f.hold((F.col("close") > f.ref("close", -1)).cast("double")), n)


def range_position(f: Frame, n: int) -> Column:
    low, high = f.hold(f.llv("low", n)), f.hold(f.hhv("high", n))
    return 100 * div(F.col("close") - low, high - low)


def weighted_roc(f: Frame, short: int = 65, middle: int = 130, long: int = 260) -> Column:
    return 0.4 * f.roc("close", short) + 0.3 * f.roc("close", middle) + 0.3 * f.roc("close", long)


def awesome(f: Frame, fast: int = 5, slow: int = 34) -> dict[str, Column]:
    mid = f.hold((F.col("high") + F.col("low")) / 2)
    ao = f.hold(f.ma(mid, fast) - f.ma(mid, slow))
    ac = f.hold(ao - f.ma(ao, fast))
    both = F.when((ao > f.ref(ao, -1)) & (ac > f.ref(ac, -1)), 1).when((ao < f.ref(ao, -1)) & (ac < f.ref(ac, -1)), -1).otherwise(0)
    return {"ao": ao, "ac": ac, "ao_state": both}


def swing_index(f: Frame, limit: float = 1000.0) -> Column:
    """Accumulated swing index, ``limit`` being the greatest move of a day."""
    c1, o1 = f.hold(f.ref("close", -1)), f.hold(f.ref("open", -1))
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    a, b, span, body = F.abs(h - c1), F.abs(l - c1), F.abs(h - l), F.abs(c1 - o1)
    r = F.when((a >= b) & (a >= span), a - b / 2 + body / 4).when((b >= a) & (b >= span), b - a / 2 + body / 4).otherwise(span + body / 4)
    one = 50 * div((c - c1) + 0.5 * (c - o) + 0.25 * (c1 - o1), r) * F.greatest(a, b) / limit
    return f.cum(f.hold(F.coalesce(one, F.lit(0.0))))


def trend_continuation(f: Frame, n: int = 35) -> dict[str, Column]:
    """Sum of rises less the run of falls, and the other way round; a sum that starts anew has no window along all bars, so it is scanned."""
    f.df = scan(f.df, {f"against_{x}": (lambda b, i=i: b.once(recur.runs_against)[i]) for i, x in enumerate(("rise", "fall"))}, f.by, f.order)
    change = f.hold(F.coalesce(F.col("close") - f.ref("close", -1), F.lit(0.0)))
    sides = {"tcf_plus": (change, "against_rise"), "tcf_minus": (-change, "against_fall")}
    return {name: f.sum(f.hold(F.greatest(move, F.lit(0.0)) - F.col(against)), n) for name, (move, against) in sides.items()}


def random_walk(f: Frame, low: int = 2, high: int = 9) -> dict[str, Column]:
    """Greatest displacement over spans of ``low`` to ``high`` bars, in mean true ranges times the root of the span."""
    tr = f.hold(f.true_range())
    ups, downs = [], []
    for n in range(low, high + 1):
        unit = f.hold(f.ma(tr, n)) * n**0.5
        ups.append(div(F.col("high") - f.ref("low", -(n - 1)), unit))
        downs.append(div(f.ref("high", -(n - 1)) - F.col("low"), unit))
    return {"rwi_high": F.greatest(*ups), "rwi_low": F.greatest(*downs)}


# -- volatility and levels ---------------------------------------------------
def historical_volatility(f: Frame, n: int = 20, year: int = 252) -> Column:
    return 100 * f.stdev(f.hold(F.log(div(F.col("close"), f.ref("close", -1)))), n, population=False) * year**0.5


def vix_fix(f: Frame, n: int = 22) -> Column:
    high = f.hold(f.hhv("close", n))
    return 100 * div(high - F.col("low"), high)


def ulcer(f: Frame, n: int = 14) -> Column:
    high = f.hold(f.hhv("close", n))
    return F.sqrt(f.ma(f.hold(F.pow(100 * div(F.col("close") - high, high), 2)), n))


def bollinger(f: Frame, n: int = 20, k: float = 2.0) -> dict[str, Column]:
    m, s = f.hold(f.ma("close", n)), f.hold(f.stdev("close", n))
    top, low = f.hold(m + k * s), f.hold(m - k * s)
    rising = lambda x: (x > f.ref(x, -1)).cast("int")
    return {"bb_top": top, "bb_mid": m, "bb_low": low, "bb_width": div(top - low, m), "bb_percent": div(F.col("close") - low, top - low), "bb_top_up": rising(top), "bb_mid_up": rising(m), "bb_low_up": rising(low)}


def envelope(f: Frame, n: int = 20, pct: float = 5.0) -> dict[str, Column]:
    m = f.hold(f.ma("close", n))
    return {"env_top": m * (1 + pct / 100), "env_low": m * (1 - pct / 100)}


def ichimoku(f: Frame, short: int = 9, middle: int = 26, long: int = 52) -> dict[str, Column]:
    """Lines as they stand on the bar: the cloud is the one drawn ``middle`` bars before; ``chikou`` compares with the close then."""
    mid = lambda n: f.hold((f.hhv("high", n) + f.llv("low", n)) / 2)
    tenkan, kijun, base = mid(short), mid(middle), mid(long)
    a, b = f.hold(f.ref(f.hold((tenkan + kijun) / 2), -middle)), f.hold(f.ref(base, -middle))
    return {"tenkan": tenkan, "kijun": kijun, "span_a": a, "span_b": b, "chikou": F.col("close") - f.ref("close", -middle)}


def ichimoku_signals(f: Frame, **periods: int) -> dict[str, Column]:
    x = {k: f.hold(v) for k, v in ichimoku(f, **periods).items()}
    c, top, low = F.col("close"), f.hold(F.greatest(x["span_a"], x["span_b"])), f.hold(F.least(x["span_a"], x["span_b"]))
    known = low.isNotNull() & x["span_a"].isNotNull()
    up, down = f.hold(f.cross(x["tenkan"], x["kijun"])), f.hold(f.cross(x["kijun"], x["tenkan"]))
    grade = F.when(up, F.when(c > top, "strong buy").when(c < low, "weak buy").otherwise("neutral buy")).when(down, F.when(c < low, "strong sell").when(c > top, "weak sell").otherwise("neutral sell")).otherwise("")
    flag = lambda b: F.coalesce(b, F.lit(False)).cast("int")
    return {"cloud": F.when(known, F.when(c > top, 1).when(c < low, -1).otherwise(0)), "cloud_green": flag(x["span_a"] > x["span_b"]), "tk_grade": F.when(known, grade).otherwise(""), "breakout": flag(f.cross("close", top)), "breakdown": flag(f.cross(low, "close")), "chikou_up": flag(x["chikou"] > 0)}


def period_extremes(f: Frame, lengths=(5, 20, 60, 120, 250)) -> dict[str, Column]:
    out = {}
    for n in lengths:
        out |= {f"high_{n}": f.hhv("high", n), f"low_{n}": f.llv("low", n), f"close_{n}": f.ref("close", -n)}
    return out


def distances(f: Frame, lengths=(20, 50, 100, 200)) -> dict[str, Column]:
    out = {}
    for n in lengths:
        high, low = f.hold(f.hhv("high", n)), f.hold(f.llv("low", n))
        out |= {f"below_high_{n}": 100 * div(F.col("close") - high, high), f"above_low_{n}": 100 * div(F.col("close") - low, low)}
    return out


def breakout(f: Frame, n: int) -> dict[str, Column]:
    top, low = f.hold(f.ref(f.hold(f.hhv("high", n)), -1)), f.hold(f.ref(f.hold(f.llv("low", n)), -1))
    return {f"break_up_{n}": F.coalesce(F.col("close") > top, F.lit(False)).cast("int"), f"break_down_{n}": F.coalesce(F.col("close") < low, F.lit(False)).cast("int"), f"level_up_{n}": top, f"level_down_{n}": low}


def pivots_of(high, low, close) -> dict[str, Column]:
    """Classic and Camarilla levels of one bar's range."""
    h, l, c = map(as_column, (high, low, close))
    p = (h + l + c) / 3
    return {"pivot": p, "r1": 2 * p - l, "s1": 2 * p - h, "r2": p + h - l, "s2": p - (h - l), "central_top": 2 * p - (h + l) / 2, "central_low": (h + l) / 2, "cam_r3": c + (h - l) * 1.1 / 4, "cam_r4": c + (h - l) * 1.1 / 2, "cam_s3": c - (h - l) * 1.1 / 4, "cam_s4": c - (h - l) * 1.1 / 2}


def tick_size_rounded(x) -> Column:
    """Price to its tick: 0.01 below 10, 0.05 below 50, else 0.1."""
    x = as_column(x)
    return F.when(x < 10, F.round(x, 2)).when(x < 50, F.round(x * 20, 0) / 20).otherwise(F.round(x, 1))


# -- volume ------------------------------------------------------------------
def obv(f: Frame) -> Column:
    c, p = F.col("close"), f.hold(f.ref("close", -1))
    return f.cum(f.hold(F.coalesce(F.signum(c - p), F.lit(0.0)) * F.col("volume")))


def accumulation(f: Frame) -> Column:
    return f.cum(f.hold(F.coalesce(div(2 * F.col("close") - F.col("high") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)) * F.col("volume")))


def price_volume_trend(f: Frame) -> Column:
    return f.cum(f.hold(F.coalesce(f.roc("close", 1), F.lit(0.0)) / 100 * F.col("volume")))


def volume_index(f: Frame, positive: bool) -> Column:
    """Sum of the percentage changes of the bars whose volume rose (or fell)."""
    before = f.hold(f.ref("volume", -1))
    moved = F.col("volume") > before if positive else F.col("volume") < before
    return 100 + f.cum(f.hold(F.when(moved, f.roc("close", 1)).otherwise(0.0)))


def williams_ad(f: Frame) -> Column:
    c, p = F.col("close"), f.hold(f.ref("close", -1))
    return f.cum(f.hold(F.when(c > p, c - F.least("low", p)).when(c < p, c - F.greatest("high", p)).otherwise(0.0)))


def trade_volume(f: Frame, tick: float = 0.5) -> Column:
    """Volume added while the last change of more than a tick was up, taken off while it was down."""
    change = f.hold(F.col("close") - f.ref("close", -1))
    side = f.hold(F.coalesce(F.last(F.when(change > tick, 1).when(change < -tick, -1), ignorenulls=True).over(f.so_far), F.lit(0)))
    return f.cum(f.hold(side * F.col("volume")))


def facilitation(f: Frame) -> dict[str, Column]:
    mfi_ = f.hold(div(F.col("high") - F.col("low"), F.col("volume")))
    up, more = mfi_ > f.ref(mfi_, -1), F.col("volume") > f.ref("volume", -1)
    return {"facilitation": mfi_, "facilitation_state": F.when(up & more, "green").when(~up & ~more, "fade").when(up & ~more, "fake").when(~up & more, "squat").otherwise("")}


def volume_split() -> dict[str, Column]:
    span = F.col("high") - F.col("low")
    buy = F.coalesce(div(F.col("volume") * (F.col("close") - F.col("low")), span), F.col("volume") / 2)
    return {"buy_volume": buy, "sell_volume": F.col("volume") - buy}


def volume_measures(f: Frame, n: int = 20) -> dict[str, Column]:
    m = f.hold(f.ma("volume", n))
    return {"volume_normal": 100 * div(F.col("volume"), m), "volume_ratio": div(F.col("volume"), f.ref(m, -1)), "volume_osc": f.ma("volume", 14) - f.ma("volume", 28)}


def session_vwap(f: Frame, ts: str = "ts", unit: str = "month") -> Column:
    """Running volume-weighted typical price since the session, week or month began."""
    session = f.hold(F.date_trunc(unit, ts))
    w = Window.partitionBy(f.by, session).orderBy(f.order).rowsBetween(Window.unboundedPreceding, 0)
    return div(F.sum(typical() * F.col("volume")).over(w), F.sum("volume").over(w))


def big_volume_levels(f: Frame, n: int = 20, times: float = 2.0, k: int = 3) -> Column:
    """Rank (1 the latest) of a ticker's bars with more than ``times`` the mean volume; null beyond k."""
    big = f.hold(F.coalesce(F.col("volume") > times * f.ma("volume", n), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy(f.by, big).orderBy(F.desc(f.order)))
    return F.when(big & (rank <= k), rank)


# -- more levels, bands and events ---------------------------------------------------------------
def regression_channel(f: Frame, n: int = 50, k: float = 2.0) -> dict[str, Column]:
    """The line of a ticker's last n closes and k residual errors about it, drawn back over those bars (looks ahead)."""
    i = f.hold(f.bar().cast("double"))
    last = f.hold(F.max(i).over(f.whole))
    inside = f.hold(F.when(i > last - n, F.col("close")))
    slope, cut = (f.hold(g(inside, i).over(f.whole)) for g in (F.regr_slope, F.regr_intercept))
    line = f.hold(F.when(inside.isNotNull(), cut + slope * i))
    err = f.hold(F.sqrt(F.sum(F.pow(inside - line, 2)).over(f.whole) / (F.count(inside).over(f.whole) - 2)))
    return {"channel": line, "channel_top": line + k * err, "channel_low": line - k * err}


def td_points(f: Frame) -> dict[str, Column]:
    """A high above those of both neighbours (looks ahead one bar), and a low below them."""
    return {"td_supply": F.coalesce((F.col("high") > f.ref("high", -1)) & (F.col("high") > f.ref("high", 1)), F.lit(False)), "td_demand": F.coalesce((F.col("low") < f.ref("low", -1)) & (F.col("low") < f.ref("low", 1)), F.lit(False))}


def rsi_zone(rsi) -> Column:
    """Label of eight zones."""
    out = F.lit("over 80")
    for top in (80, 70, 60, 50, 40, 30, 20):
        out = F.when(as_column(rsi) <= top, F.lit(f"to {top}")).otherwise(out)
    return F.when(as_column(rsi).isNotNull(), out)


def trend_strength(adx) -> Column:
    x = as_column(adx)
    return F.when(x < 20, "none").when(x < 25, "weak").when(x < 40, "trending").when(x < 60, "strong").otherwise(F.when(x.isNotNull(), "extreme"))


def predicted_stoch(f: Frame, n: int = 14, change: float = 1.0) -> Column:
    """%K (unsmoothed) of a next bar that closes ``change`` percent higher at its high."""
    next_close = F.col("close") * (1 + change / 100)
    high, low = F.greatest(f.hold(f.hhv("high", n - 1)), next_close), F.least(f.hold(f.llv("low", n - 1)), next_close)
    return 100 * div(next_close - low, high - low)


def fibonacci_levels(f: Frame, n: int = 120) -> dict[str, Column]:
    high, low = f.hold(f.hhv("high", n)), f.hold(f.llv("low", n))
    return {f"fib_{int(1000 * x)}": high - x * (high - low) for x in (0.236, 0.382, 0.5, 0.618, 0.786)}


def first_bar_trigger(f: Frame, atr, k: float = 0.5, unit: str = "day") -> dict[str, Column]:
    """Levels about the session's first open, k true ranges away."""
    session = f.hold(F.date_trunc(unit, f.order))
    first = F.first("open").over(Window.partitionBy(f.by, session).orderBy(f.order).rowsBetween(Window.unboundedPreceding, 0))
    return {"trigger_up": first + k * as_column(atr), "trigger_down": first - k * as_column(atr)}


def targets(entry, stop, steps=(1, 2, 3)) -> dict[str, Column]:
    """Targets at whole multiples of the risk, and the risk in percent of the entry."""
    e, s = as_column(entry), as_column(stop)
    return {f"target_{n}": e + n * (e - s) for n in steps} | {"risk_percent": 100 * div(e - s, e)}


def amplitude(pct: float = 7.0) -> dict[str, Column]:
    return {"amp_top": F.col("close") * (1 + pct / 100), "amp_low": F.col("close") * (1 - pct / 100)}


def three_day_break(f: Frame) -> dict[str, Column]:
    """Close beyond the extremes of the three bars before, by an offset that grows with the price."""
    offset = F.when(F.col("close") < 10, 0.05).when(F.col("close") < 50, 0.1).otherwise(0.002 * F.col("close"))
    top, low = F.greatest(*[f.ref("high", -n) for n in (1, 2, 3)]), F.least(*[f.ref("low", -n) for n in (1, 2, 3)])
    return {"three_up": F.coalesce(F.col("close") > top + offset, F.lit(False)), "three_down": F.coalesce(F.col("close") < low - offset, F.lit(False))}


def ribbon(f: Frame, short=(3, 15), long=(30, 60)) -> dict[str, Column]:
    """Mid prices over short and long spans: whether all short ones lie above all long ones."""
    mid = lambda n: f.hold((f.hhv("high", n) + f.llv("low", n)) / 2)
    a, b = [mid(n) for n in range(short[0], short[1] + 1, 3)], [mid(n) for n in range(long[0], long[1] + 1, 10)]
    up = f.hold(F.least(*a) > F.greatest(*b))
    return {"ribbon_up": F.coalesce(up, F.lit(False)), "ribbon_down": F.coalesce(F.greatest(*a) < F.least(*b), F.lit(False))}


def swing_stop(f: Frame, n: int = 20) -> Column:
    """The low before the last n-bar breakout upwards, or the high before the last one downwards."""
    b = {k: f.hold(v) for k, v in breakout(f, n).items()}
    low, high = f.hold(f.llv("low", 5)), f.hold(f.hhv("high", 5))
    return F.last(F.when(b[f"break_up_{n}"] == 1, low).when(b[f"break_down_{n}"] == 1, high), ignorenulls=True).over(f.so_far)


def average_range_stop(f: Frame, n: int = 22, k: float = 3.0) -> Column:
    return f.hhv("high", n) - k * f.ma(f.hold(F.col("high") - F.col("low")), n)


def latched_rise(f: Frame, n: int = 5) -> dict[str, Column]:
    """1 since the close last rose above its n-bar high before, -1 since it fell below the low, and bars in that state."""
    top, low = f.hold(f.ref(f.hold(f.hhv("high", n)), -1)), f.hold(f.ref(f.hold(f.llv("low", n)), -1))
    state = f.hold(F.coalesce(F.last(F.when(F.col("close") > top, 1).when(F.col("close") < low, -1), ignorenulls=True).over(f.so_far), F.lit(0)))
    return {"latched": state, "latched_bars": f.run_length(f.hold(state == f.ref(state, -1)))}


def daily_volume(f: Frame, n: int = 10) -> Column:
    """Running sum of volume, added above the mean close of n bars and taken off below it."""
    return f.cum(f.hold(F.coalesce(F.signum(F.col("close") - f.ma("close", n)), F.lit(0.0)) * F.col("volume")))


def accumulation_share(f: Frame, n: int = 20) -> Column:
    """Volume of rising bars less that of falling ones over n bars, in percent of all."""
    signed = f.hold(F.coalesce(F.signum(F.col("close") - f.ref("close", -1)), F.lit(0.0)) * F.col("volume"))
    return 100 * div(f.sum(signed, n), f.sum("volume", n))


def interest_label(f: Frame, interest) -> Column:
    up, more = F.col("close") > f.ref("close", -1), as_column(interest) > f.ref(interest, -1)
    return F.when(up & more, "long build-up").when(~up & more, "short build-up").when(up & ~more, "short covering").when(~up & ~more, "long unwinding").otherwise("")


def session_minutes(ts, opens: str = "09:00", closes: str = "15:00", rest: tuple[str, str] = ("11:30", "13:00")) -> Column:
    """Trading minutes that have passed at ``ts``, without the midday rest."""
    of = lambda s: int(s[:2]) * 60 + int(s[3:])
    now = F.hour(ts) * 60 + F.minute(ts)
    clip = lambda a, b: F.greatest(F.lit(0), F.least(now, F.lit(of(b))) - of(a))
    return clip(opens, rest[0]) + clip(rest[1], closes)


def expected_volume(volume, ts, whole: int = 270) -> Column:
    """Volume that the session would reach at its present pace."""
    return div(as_column(volume) * whole, session_minutes(ts))


def transaction_speed(f: Frame, ts, whole: int = 270) -> Column:
    """Volume a minute: of the whole session, on a ticker's last bar of the minutes that have passed."""
    last = F.lead(F.lit(1)).over(f.w).isNull()
    return F.when(last, div(F.col("volume"), session_minutes(ts))).otherwise(F.col("volume") / whole)


def taichi(f: Frame, lengths: tuple[int, int, int] = (9, 26, 52)) -> dict[str, Column]:
    """Mean of the cloud's four lines, the mean of its spans, and two weighted means of the first."""
    a, b, c = lengths
    middle = f.hold_all({str(n): (f.hhv("high", n) + f.llv("low", n)) / 2 for n in lengths})
    fast, slow, wide = (middle[str(n)] for n in lengths)
    spans = f.hold_all({"a": f.ref((slow + fast) / 2, -b), "b": f.ref(wide, -b)})
    line = f.hold((fast + slow + spans["a"] + spans["b"]) / 4)
    return {"taichi": line, "taichi_ahead": (spans["a"] + spans["b"]) / 2, "signal": f.wma(line, b), "slow_signal": f.wma(line, c)}


def pressure(f: Frame, bought, sold, n: int = 20, smooth: int = 5) -> dict[str, Column]:
    """Buying and selling pressure: the close's distance from low and high against its mean, weighted by volume and order flow."""
    share = 1 - 1 / (1 + as_column(bought) / (as_column(sold) + 0.001))
    h = f.hold_all({"up": F.col("close") - F.col("low"), "down": F.col("high") - F.col("close"), "share": share})
    m = f.hold_all({k: f.ma(v, n) for k, v in h.items()} | {"volume": f.ma("volume", n)})
    busy = div(F.col("volume"), m["volume"])
    known = as_column(bought).isNotNull() | as_column(sold).isNotNull()
    raw = {
        "buying": div(h["up"], m["up"]) * (busy + F.when(known, m["share"]).otherwise(0)),
        "selling": div(h["down"], m["down"]) * (busy + F.when(known, 1 - m["share"]).otherwise(0)),
    }
    smoothed = f.hold_all({k: f.ma(v, smooth) for k, v in f.hold_all(raw).items()})
    return smoothed | {"pressure": smoothed["buying"] - smoothed["selling"]}
