"""DuckDB SQL of the volume-price sheet, written from the published formula text rather than from the operators."""

from __future__ import annotations

from tickloom.plans.sqltext import KEYS, full, hhv, lag, llv, ma, over, r, staged
from tickloom.plans.walks import NUMBERED, ema, walk, wilders


def t(x: str) -> str:
    return f"coalesce({x}, false)"


_MEANS = {"avg_spread": ema("high - low", 40), "avg_move": ema("abs(close - open)", 40), "mean_spread": wilders("high - low", 40), "mean_result": wilders("abs(close - c1)", 40)}
_UNITS = {f"u{n}": f"({ma('tr', n)}) * sqrt({n})" for n in range(2, 41)}
_WALKS = {
    f"{side}_{name}": "greatest(" + ", ".join(f"({shape.format(lag(other, n - 1))}) / nullif(u{n}, 0)" for n in range(low, high + 1)) + ")"
    for name, low, high in (("now", 2, 7), ("long", 8, 40)) for side, shape, other in (("up", "high - {}", "low"), ("down", "{} - low", "high"))
}
_RAW = {
    **{f"{x[0]}{i}": lag(x, i) for x, most in (("close", 5), ("high", 1), ("low", 1), ("volume", 2)) for i in range(1, most + 1) if (x, i) != ("close", 1)},
    "s": "high - low", "va": full("CAST(sum({x}) {w} AS DOUBLE) / 30", "volume", 30), "h5": hhv("high", 5), "l5": llv("low", 5), "h10": hhv("high", 10), "v60": hhv("volume", 60), "j5": ma("close", 5), "k": "CAST(i - 1 AS DOUBLE)",
}
_TERMS = {
    "wrb": t("s > 1.5 * avg_spread"), "nrb": t("s < 0.7 * avg_spread"), "asb": t("s > avg_spread"), "lowv": t("volume < v1 AND volume < v2 AND volume < va"), "highv": t("volume > v1 AND v1 > v2"), "upb": t("close > c1"), "dnb": t("close < c1"), "vb": t("volume > va OR volume > v1"),
    "upc": "close >= s * 0.7 + low", "dnc": "close <= s * 0.3 + low", "abc": "close > s * 0.5 + low", "blc": "close < s * 0.5 + low", "mdc": "close > s * 0.3 + low AND close < s * 0.7 + low", "fgh": t("high = h5"), "fgl": t("low = l5"),
    "cp": "CASE WHEN close <= s * 0.2 + low THEN 1 WHEN close <= s * 0.4 + low THEN 2 WHEN close <= s * 0.6 + low THEN 3 WHEN close <= s * 0.8 + low THEN 4 ELSE 5 END",
    "vp": "CASE WHEN volume > va * 2 THEN 1 WHEN volume > va * 1.3 THEN 2 WHEN volume >= va THEN 3 WHEN volume < va AND volume > va * 0.7 THEN 4 ELSE 5 END",
    "pos": "CASE WHEN close = low THEN avg_spread ELSE s / (close - low + 1e-9) END", "vm": full("stddev_pop({x}) {w}", "va", 30), "j": "up_long - down_long",
    **{f"trend_{n}": full("regr_slope(j5, k) {w}", "j5", n) for n in (40, 10, 3)},
    "upmajor": "CASE WHEN up_long - down_long > 1 THEN 1 WHEN up_long - down_long < -1 THEN -1 ELSE 0 END", "upminor": "CASE WHEN up_long > 1 THEN 1 ELSE -1 END", "dnminor": "CASE WHEN down_long > 1 THEN 1 ELSE -1 END", "upimd": "CASE WHEN up_now > 1 THEN 1 ELSE 0 END", "dnimd": "CASE WHEN down_now > 1 THEN 1 ELSE 0 END",
}
_ONE = {
    **{f"{x}_1": t(lag(x)) for x in ("upb", "dnb", "wrb", "dnc")}, "ut": f"wrb AND dnc AND upimd = 1 AND {t('high > h1')}", "hup": t("high > h1"),
    "sdn": f"vp < 4 AND {t(lag('dnb'))} AND upb AND cp > 3 AND upimd <= 0 AND upminor < 0", "sdn1": f"upmajor < 0 AND {t('volume > va * 1.5')} AND {t(lag('dnb'))} AND upb AND cp > 3 AND upminor < 0 AND upimd <= 0", "lvt": "fgl AND upc AND lowv",
    "rut": f"upmajor < 0 AND upb AND upc AND {t('volume > v1')} AND {t('volume > va')} AND wrb AND {t(lag('dnb'))} AND {t(lag('dnc'))} AND upminor < 0",
    "eu": f"{t('high > h1')} AND {t('low > l1')} AND upb AND close >= s * 0.7 + low AND asb AND vp < 4", "ed": f"{t('high < h1')} AND {t('low < l1')} AND dnb AND close <= s * 0.25 + low AND wrb AND vp < 4",
}
_TWO = {
    "put": f"upb_1 AND hup AND {t('v1 > 1.5 * va')} AND dnb AND dnc AND NOT ut", "k1": f"{t(lag('ut'))} AND dnb AND NOT nrb", "k2": f"{t(lag('ut'))} AND dnb AND vp = 2", "k3": "ut AND vp = 1",
    "buyc": f"upb AND {t(lag('sdn OR sdn1'))}", "lvt2": f"{t(lag('lvt'))} AND upb AND upc", "edf": f"{t(lag('ed'))} AND ((upb AND asb) OR rut OR sdn OR sdn1)",
    "ndu": "upb AND nrb AND lowv AND cp > 3 AND ((upminor = 1 AND upimd = 1) OR (upminor = 1 AND upmajor = 1))", "ndd": "upb AND nrb AND lowv AND cp > 3 AND (upminor = -1 OR upimd = -1)", "nsb": "dnb AND nrb AND lowv AND cp < 3 AND ((upminor < 1 AND upimd < 1) OR (upminor > 0 AND upimd < 1))",
    "lvt1": f"fgl AND {t('volume < va')} AND {t('low < l1')} AND upc AND upminor > 0 AND upmajor > 0", "stop": f"fgl AND (upc OR mdc) AND {t('volume > 1.5 * va')} AND upmajor < 0", "bc": f"wrb AND abc AND {t('volume = v60')} AND upmajor = 1", "sc": f"wrb AND blc AND {t('volume = v60')} AND upmajor = -1",
}
_THREE = {
    "sell1": "k1 OR k2 OR k3", "tch": f"upb_1 AND fgh AND dnb AND (dnc OR mdc) AND {t('volume > va')} AND upmajor > 0 AND upimd > 0 AND NOT wrb AND NOT put", "put2": f"{t(lag('put'))} AND dnb AND dnc AND NOT ut", "euf": f"{t(lag('eu'))} AND (ut OR k1 OR k2 OR k3 OR (dnb AND asb))",
    "trb": f"{t('v1 > va')} AND upb_1 AND wrb_1 AND dnb AND dnc AND wrb AND upmajor > 0 AND {t('high = h10')}", "sdn2": f"upimd <= 0 AND {t('v1 < va')} AND upb AND {t('pos < 1.35')} AND vp < 4",
}
_FOUR = {"sellc": f"sell1 AND NOT coalesce({lag('sell1')}, true)"}
_FIVE = {"flag": "sellc OR buyc OR eu OR euf OR stop OR ed OR edf OR rut OR ndd OR ndu OR nsb OR lvt OR lvt1 OR lvt2 OR bc"}
_SIX = {"bull": f"vb AND {t('pos < 2')} AND upb AND NOT flag", "bear": "vb AND dnc AND dnb AND asb AND NOT flag"}
_WEAK = {
    "up_thrust": "ut", "new_up_thrust": "wrb AND dnc AND fgh AND highv", "buying_climax": "bc", "up_thrust_minor": "wrb AND cp IN (1, 2) AND upminor > 0 AND hup AND (upimd > 0 OR upmajor > 0) AND vp < 4", "up_thrust_true": "wrb AND cp = 1 AND upmajor > 0 AND hup AND vp < 4", "up_thrust_cond1": "k1", "up_thrust_cond2": "k2", "up_thrust_cond3": "k3",
    "sell_cond": "sellc", "top_reversal": "trb", "pseudo_up_thrust": "put", "pseudo_confirmed": "put2", "trend_change": "tch", "no_demand_up": "ndu", "no_demand_down": "ndd", "effort_down": "ed", "effort_up_fails": "euf", "bear_bar": "bear",
}
_STRONG = {
    "no_supply": "nsb", "low_test": "lvt", "low_test1": "lvt1", "low_test2": "lvt2", "strength_down0": "sdn AND upmajor < 0", "strength_down": "sdn", "strength_down1": "sdn1", "strength_down2": "sdn2", "buy_cond": "buyc", "stopping_volume": "stop", "rev_up_thrust": "rut", "effort_up": "eu", "effort_down_fails": "edf", "selling_climax": "sc", "bull_bar": "bull",
}


def labels(parts: dict[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {e} THEN '{n}' END" for n, e in parts.items()) + ")"


def flag(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def _event(level: str, line: int, above: bool) -> str:
    one, two = lag(level, 1), lag(level, 2)
    return t(f"{level} > {line} AND {one} > {line} AND {two} <= {line}" if above else f"{level} < {line} AND {one} < {line} AND {two} >= {line}")


CLASSES = {
    "volume_class": "CASE WHEN volume > va * 2 THEN '5. Higher' WHEN volume > va * 1.3 THEN '4. High' WHEN volume > va THEN '3. Average Above' WHEN volume < va AND volume > va * 0.7 THEN '2. Average Less than' WHEN volume < va - vm THEN '1. Low' ELSE '' END",
    "spread_class": "CASE WHEN s > avg_spread * 1.5 THEN '5. Wide' WHEN s > avg_spread THEN '4. Average Above' WHEN s < avg_spread AND s >= avg_spread * 0.7 THEN '3. Average Below' WHEN s < avg_spread * 0.5 THEN '1. Narrow Very' ELSE '2. Narrow' END",
    "close_class": "CASE cp WHEN 5 THEN 'High' WHEN 4 THEN 'Upper side' WHEN 3 THEN 'Mid' WHEN 2 THEN 'Lower Side' ELSE 'Low' END",
}
_FELL, _ROSE = t("c1 < c5 AND c1 < c4 AND c1 < c3 AND c1 < c2"), t("c1 > c5 AND c1 > c4 AND c1 > c3 AND c1 > c2")
_OUTSIDE, _BUSY, _CALM = t("low < l1 AND high > h1"), t("volume > 1.2 * va"), t("volume <= 1.2 * va")
STATE = {
    "weakness": labels(_WEAK), "strength": labels(_STRONG), "is_strong": flag("sdn OR sdn1 OR sdn2 OR (sdn AND upmajor < 0) OR bull OR eu OR upb OR lvt OR lvt1 OR lvt2 OR rut OR stop"), "is_weak": flag("ut OR k1 OR k2 OR k3 OR put OR put2 OR ed OR tch OR ndd OR bear OR dnb OR nsb"),
    "effort_no_result": flag(t("volume > 1.5 * va AND abs(close - open) < 0.5 * avg_move")), "two_bar_up_busy": flag(f"{_FELL} AND {_OUTSIDE} AND {_BUSY} AND upc"), "two_bar_up_busy_inside": flag(f"{_FELL} AND {t('low < l1 AND close > c1')} AND {_BUSY} AND upc AND NOT {_OUTSIDE}"),
    "two_bar_up_calm": flag(f"{_FELL} AND {_OUTSIDE} AND upc AND {_CALM}"), "two_bar_down_busy": flag(f"{_ROSE} AND {_OUTSIDE} AND {_BUSY} AND dnc"), "two_bar_down_calm": flag(f"{_ROSE} AND {_OUTSIDE} AND dnc AND {_CALM}"),
    **{n: flag(n) for n in ("upmajor", "upminor", "dnminor", "upimd", "dnimd")},
    **{f"{n}_{on}": flag(_event(level, line, rises == (on == "on"))) for n, level, line, rises in (("upmajor", "j", 1, True), ("dnmajor", "j", -1, False), ("upminor", "up_long", 1, True), ("dnminor", "down_long", 1, True)) for on in ("on", "off")},
}
NUMBERS = {f"trend_{n}": f"trend_{n}" for n in (40, 10, 3)} | {"volume_mean": "va"} | {f"volume_up{n}": f"va + {n} * vm" for n in (1, 2, 3)} | {f"volume_down{n}": f"va - {n} * vm" for n in (1, 2)}


def _wma(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {over(n)} >= {n} THEN (sum({x} * (i - 1)) {over(n)} - ((i - 1) - {n}) * sum({x}) {over(n)}) / ({n} * ({n} + 1) / 2.0) END"


_FORCES = [
    {"fb": "coalesce(volume * (close - low) / nullif(s, 0), 0)", "fs": "coalesce(volume * (high - close) / nullif(s, 0), 0)"},
    {"buy": _wma("fb", 20), "sell": _wma("fs", 20), "rs": "s / nullif(mean_spread, 0)", "rv": f"volume / nullif({_wma('volume', 40)}, 0)", "rr": "abs(close - c1) / nullif(mean_result, 0)"},
    {f"{x}_{e}": f(x, 40) for x in ("buy", "sell", "rs", "rv", "rr") for e, f in (("top", hhv), ("low", llv))},
]
_SCALED = {
    "buy_force": "100 * (buy - least(buy_low, sell_low)) / nullif(greatest(buy_top, sell_top) - least(buy_low, sell_low), 0)", "sell_force": "100 * (sell - least(buy_low, sell_low)) / nullif(greatest(buy_top, sell_top) - least(buy_low, sell_low), 0)",
    **{f"{n}_norm": f"100 * ({x} - {x}_low) / ({x}_top - {x}_low + 1e-9)" for n, x in (("spread", "rs"), ("volume", "rv"), ("result", "rr"))},
}
STEPS = [_UNITS, _WALKS, _RAW, _TERMS, _ONE, _TWO, _THREE, _FOUR, _FIVE, _SIX]
CTES = walk(_MEANS, NUMBERED)
SHEET = staged([*STEPS, *_FORCES], KEYS | CLASSES | STATE | {n: r(x, 3) for n, x in (NUMBERS | _SCALED).items()}, source="w", ctes=CTES, recursive=True)
CLASS_SQL = staged(STEPS[:4], KEYS | CLASSES, source="w", ctes=CTES, recursive=True)
