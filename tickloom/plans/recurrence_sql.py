"""DuckDB SQL of the recurrence queries: window layers and recursive walks in turn, each over the table before it."""

from __future__ import annotations

from math import exp

from tickloom.plans import walks
from tickloom.plans.bars import BARS_SQL, INTRADAY_SQL
from tickloom.plans.sqltext import KEYS, SO_FAR, SPEC, W, full, hhv, lag, llv, ma, over, r, total
from tickloom.plans.swing_queries import zigzag

Layer = dict[str, str] | dict[str, tuple[str, str]]
ema, wilders = walks.ema, walks.wilders
INTRADAY = (
    INTRADAY_SQL.format(width="15 minutes").replace("ticks AS", "events_of AS").replace("FROM ticks", "FROM events_of")
    + f", b AS MATERIALIZED (SELECT *, row_number() {W} AS i FROM intraday)"
)


def layered(layers: list[Layer], out: dict[str, str], ctes: str = walks.NUMBERED, tail: str = "", source: str = "b") -> str:
    """A query over ``source``: a layer of texts adds window columns, one of pairs walks along the bars (``walks.walk``)."""
    for n, layer in enumerate(layers):
        if isinstance(next(iter(layer.values())), tuple):
            ctes = walks.walk(layer, ctes=ctes, source=source, into=f"q{n}")
        else:
            ctes += f", q{n} AS MATERIALIZED (SELECT *, {', '.join(f'{x} AS {c}' for c, x in layer.items())} FROM {source})"
        source = f"q{n}"
    return f"WITH RECURSIVE {ctes} SELECT {', '.join(f'{x} AS {c}' for c, x in out.items())} FROM {source} {tail}"


def cross(a: str, b: str) -> str:
    return f"coalesce({a} > {b} AND {lag(a)} <= {lag(b)}, false)::BIGINT"


def same(x: str) -> tuple[str, str]:
    """A value of the bar itself, for use by the smooths after it."""
    return x, "1"


def weighted(x: str, n: int, weights: list[float] | None = None) -> str:
    """Mean of the last n values by weights, the current bar's last; null until all are there."""
    w = weights or list(range(1, n + 1))
    return f"(({' + '.join(f'{v!r} * {lag(x, n - 1 - i) if i < n - 1 else x}' for i, v in enumerate(w))}) / {sum(w)!r})"


def chain(prefix: str, x: str, n: float, depth: int) -> dict[str, tuple[str, str]]:
    """``depth`` exponential means, each of the one before: prefix1, prefix2, ..."""
    return {f"{prefix}{k}": ema(x if k == 1 else f"{prefix}{k - 1}", n) for k in range(1, depth + 1)}


def tema_of(p: str) -> str:
    return f"(3 * {p}1 - 3 * {p}2 + {p}3)"


def rsi_layers(series: dict[str, tuple[str, int]]) -> list[Layer]:
    """Layers that add the RSI of each name's (series, length), its smooths ``g_`` and ``l_`` starting with the mean of the first changes."""
    items = series.items()
    part = lambda s, side, n: f"CASE WHEN ch_{s} IS NOT NULL THEN CASE WHEN k_{s} = {n} THEN avg(greatest({side}ch_{s}, 0)) {over(n)} WHEN k_{s} > {n} THEN greatest({side}ch_{s}, 0) END END"
    return [
        {f"ch_{s}": f"{x} - {lag(x)}" for s, (x, _) in items},
        {f"k_{s}": f"count(ch_{s}) {SO_FAR}" for s, _ in items},
        {f"{side}_{s}": part(s, sign, n) for s, (_, n) in items for side, sign in (("up", ""), ("dn", "-"))},
        {f"{y}_{s}": wilders(f"{side}_{s}", n) for s, (_, n) in items for y, side in (("g", "up"), ("l", "dn"))} | {s: same(f"100 * g_{s} / nullif(g_{s} + l_{s}, 0)") for s, _ in items},
    ]


def hma_layers(name: str, x: str, n: int, last: int | None = None) -> list[Layer]:
    return [{f"{name}_raw": f"2 * {weighted(x, max(1, n // 2))} - {weighted(x, n)}"}, {name: weighted(f"{name}_raw", last or max(1, int(n**0.5)))}]


def stoch(x: str, n: int) -> str:
    return f"100 * ({x} - ({llv(x, n)})) / nullif(({hhv(x, n)}) - ({llv(x, n)}), 0)"


SQL: dict[str, str] = {}
_GUPPY = (3, 5, 8, 10, 12, 15, 30, 35, 40, 45, 50, 60)
_T3 = {"f6": -(0.618**3), "f5": 3 * 0.618**2 + 3 * 0.618**3, "f4": -6 * 0.618**2 - 3 * 0.618 - 3 * 0.618**3, "f3": 1 + 3 * 0.618 + 0.618**3 + 3 * 0.618**2}
_ALMA = [exp(-((k - 0.85 * 8) ** 2) / (2 * (9 / 6) ** 2)) for k in range(9)]
SQL["r_averages"] = layered(
    [
        {"m14": f"CASE WHEN i = 14 THEN avg(close) {over(14)} WHEN i > 14 THEN close END"},
        {"w14": wilders("close", 14), "sm": wilders("m14", 14)} | chain("a", "close", 10, 3) | {"t": same(tema_of("a"))} | chain("t", "t", 10, 3) | chain("f", "close", 5, 6) | {f"g{n}": ema("close", n) for n in _GUPPY},
        *hma_layers("hma", "close", 9),
    ],
    KEYS
    | {"wilders": r("w14"), "smma": r("sm"), "dema": r("2 * a1 - a2"), "tema": r("t"), "t3": r(" + ".join(f"{v!r} * {c}" for c, v in _T3.items())), "zlma": r("2 * a1 - a2"), "zltema": r(f"2 * t - {tema_of('t')}")}
    | {"alma": r(weighted("close", 9, _ALMA)), "hma": r("hma"), "displaced": r(lag("a1", 3))}
    | {f"guppy{n}": r(f"g{n}") for n in _GUPPY},
)

SQL["e18_rsi_targets"] = layered(
    [*rsi_layers({"rsi": ("close", 14)}), {f"gap_{t}": f"13 * (l_rsi * {t} / (100 - {t}) - g_rsi)" for t in (30, 50, 70)}],
    KEYS | {"close": r("close"), "rsi": r("rsi")} | {f"price_{t}": r(f"CASE WHEN gap_{t} >= 0 THEN close + gap_{t} ELSE close + gap_{t} * (100 - {t}) / {t} END") for t in (30, 50, 70)},
)
SQL["e19_atr_rank"] = layered(
    [
        {"atr": wilders("tr", 14)},
        {"line": full(f"regr_intercept({{x}}, CAST(i AS DOUBLE)) {{w}} + regr_slope({{x}}, CAST(i AS DOUBLE)) {{w}} * i", "atr", 10)},
        {"before": f"list(line) OVER ({SPEC} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)"},
    ],
    KEYS | {"atr_rank": r("CASE WHEN len(list_filter(before, lambda v: v IS NOT NULL)) = 100 THEN CAST(len(list_filter(before, lambda v: v < line)) AS DOUBLE) END")},
)
SQL["e24_rsi_ema_cross"] = (
    "SELECT * FROM ("
    + layered(
        [*rsi_layers({"rsi": ("close", 14)}), {"e5": ema("close", 5), "e20": ema("close", 20)} | chain("s", "close", 9, 3) | chain("u", "close", 20, 3), {"t9": tema_of("s"), "t20": tema_of("u"), "half": "50.0"}],
        KEYS | {"ema_cross": cross("e5", "e20"), "tema_cross": cross("t9", "t20"), "rsi_cross": cross("rsi", "half")},
    )
    + ") WHERE ema_cross + tema_cross + rsi_cross > 0"
)
SQL["e25_adx_scanner"] = (
    "SELECT ticker, ts, adx, up, label FROM ("
    + layered([walks.DIRECTIONAL], KEYS | {"raw": "adx", "adx": r("adx"), "up": cross("plus", "minus"), "label": "CASE WHEN adx > 40 THEN 'strong' WHEN adx > 25 THEN 'trend' WHEN adx > 15 THEN 'weak' ELSE 'none' END"}, ctes=walks.RICH, source="c")
    + ") WHERE raw > 25"
)
_WAVE = {"ap": same("(high + low + close) / 3"), "esa": ema("ap", 10), "dev": ema("abs(ap - esa)", 10), "wt": ema("(ap - esa) / nullif(0.015 * dev, 0)", 21)}
SQL["e27_wave_trend_15m"] = layered([_WAVE, {"line": ma("wt", 4)}], KEYS | {"wt": r("wt"), "wt_line": r("line"), "wt_up": cross("wt", "line"), "wt_down": cross("line", "wt")}, ctes=INTRADAY)
SQL["e29_average_strategies"] = (
    "SELECT * FROM ("
    + layered(
        [chain("s", "close", 9, 3) | chain("u", "close", 20, 3), {"t9": tema_of("s"), "t20": tema_of("u"), "h20": hhv("high", 20), "mv": ma("volume", 20), "m3": ma("close", 3), "m20": ma("close", 20)}, {"top": lag("h20")}],
        KEYS | {"close": r("close"), "tema_entry": cross("t9", "t20"), "break_entry": "coalesce(close > u1 AND close > top AND volume > mv, false)::BIGINT", "mean_entry": cross("m3", "m20")},
    )
    + ") WHERE tema_entry + break_entry + mean_entry > 0"
)
SQL["e36_stack_pullback"] = layered(
    [{"e20": ema("close", 20), "e50": ema("close", 50)}, {"raw": f"(close - ({llv('low', 14)})) / nullif(({hhv('high', 14)}) - ({llv('low', 14)}), 0)", "m100": ma("close", 100), "m200": ma("close", 200)}, {"k14": f"100 * ({ma('raw', 3)})"}],
    KEYS | {"close": r("close"), "ema20": r("e20"), "ema50": r("e50"), "k14": r("k14")},
    tail="WHERE e20 > e50 AND m100 > m200 AND close < e20 AND k14 < 20",
)

_FOUR = "(open + high + low + close) / 4"
_MID = "(high + low) / 2"
_NESTED = [{f"y{k}": ma(f"y{k - 1}" if k > 1 else "close", 2)} for k in range(1, 11)]
SQL["r_oscillators"] = layered(
    [
        {"x4": _FOUR, "x3": "(high + low + close) / 3"},
        *hma_layers("h3", "x3", 10),
        *rsi_layers({"rsi": ("close", 14), "rsi50": ("close", 50), "rsi40": ("close", 40), "rsi4": ("x4", 14), "rsih": ("h3", 14)}),
        *hma_layers("sent", "rsi4", 20),
        *_NESTED,
        {
            "d5": f"close - {lag('close', 5)}", "d1": f"close - {lag('close')}", "h13": hhv("high", 13), "l13": llv("low", 13), "st10": stoch("close", 10), "tr14": total("tr", 14), "srsi": stoch("rsi", 14),
            "vp": f"abs(high - {lag('low')})", "vm": f"abs(low - {lag('high')})", "h10": hhv("close", 10), "l10": llv("close", 10), "d9": f"close - {lag('close', 9)}", "root": f"sqrt((close - {lag('close')}) * (close - {lag('close')}) + 1)", "off": f"close - ({ma('close', 25)})",
        },
        {"vp14": total("vp", 14), "vm14": total("vm", 14), "path": total("root", 9), "zz": f"(off - ({ma('off', 25)})) / nullif(({full('stddev_pop({x}) {w}', 'off', 25)}), 0)"},
        {"vxp": "vp14 / nullif(tr14, 0)", "vxm": "vm14 / nullif(tr14, 0)"},
        walks.DIRECTIONAL
        | {"zr1": ema("rsi", 14), "zr2": ema("zr1", 14), "u5": wilders("CASE WHEN d5 IS NOT NULL THEN greatest(d5, 0) END", 14), "n5": wilders("CASE WHEN d5 IS NOT NULL THEN greatest(-d5, 0) END", 14)}
        | chain("tx", "close", 9, 3)
        | {"ts1": ema("d1", 25), "ts2": ema("ts1", 13), "ta1": ema("abs(d1)", 25), "ta2": ema("ta1", 13), "sm1": ema("close - (h13 + l13) / 2", 25), "sm2": ema("sm1", 2), "sr1": ema("h13 - l13", 25), "sr2": ema("sr1", 2)}
        | {"ds": ema("st10", 3), "vadx": wilders("100 * abs(vxp - vxm) / nullif(vxp + vxm, 0)", 14), "mi1": ema("high - low", 9), "mi2": ema("mi1", 9), "o9": ema("close", 9), "o18": ema("close", 18), "e13": ema("close", 13)}
        | _WAVE
        | {"f23": ema("close", 23), "f50": ema("close", 50), "pe": ema("sign(d9) * 100 * sqrt(d9 * d9 + 81) / nullif(path, 0)", 5), "tp1": ema("zz", 20), "tp2": ema("tp1", 20)},
        {"ratio": "mi1 / nullif(mi2, 0)", "ds2": stoch("ds", 10), "mx": "f23 - f50"},
        {"sc1": stoch("mx", 10)},
        {"sc1f": f"last_value(sc1 IGNORE NULLS) {SO_FAR}"},
        {"dss": ema("ds2", 3), "p1": ("sc1f", "0.5")},
        {"sc2": stoch("p1", 10)},
        {"sc2f": f"last_value(sc2 IGNORE NULLS) {SO_FAR}"},
        {"schaff": ("sc2f", "0.5")},
        {f"gap_{t}": f"13 * (l_rsi * {t} / (100 - {t}) - g_rsi)" for t in (30, 70)},
    ],
    KEYS
    | {"stoch_rsi": r(ma("srsi", 3)), "zero_lag_rsi": r("2 * zr1 - zr2"), "sentimental": r("sent"), "hull_rsi": r("rsih"), "rmi": r("100 * u5 / nullif(u5 + n5, 0)"), "trix": r(f"100 * (tx3 / nullif({lag('tx3')}, 0) - 1)")}
    | {f"zone_{n}": r(f"({ma('rsi', 50)}) {s} ({full('stddev_pop({x}) {w}', 'rsi', 50)})") for n, s in (("top", "+"), ("low", "-"))}
    | {"tsi": r("100 * ts2 / nullif(ta2, 0)"), "smi": r("100 * sm2 / nullif(sr2 / 2, 0)"), "dss": r("dss"), "plus_di": r("plus"), "minus_di": r("minus"), "adx": r("adx"), "vortex_plus": r("vxp"), "vortex_minus": r("vxm"), "vortex_adx": r("vadx")}
    | {"mass": r(total("ratio", 25)), "oscp": r("100 * (o9 - o18) / nullif(o18, 0)"), "wave_trend": r("wt"), "rahul": r(f"100 * (close - ({' + '.join(f'y{k}' for k in range(1, 11))}) / 10) / nullif(h10 - l10, 0)"), "bull": r("high - e13"), "bear": r("low - e13")}
    | {"banker": r("CASE WHEN rsi50 IS NOT NULL THEN greatest(0, least(20, 1.5 * (rsi50 - 50))) END"), "hot_money": r("CASE WHEN rsi40 IS NOT NULL THEN greatest(0, least(20, 0.7 * (rsi40 - 30))) END"), "schaff": r("schaff"), "efficiency": r("pe"), "two_poles": r("tp2")}
    | {f"rsi_{t}": r(f"CASE WHEN gap_{t} >= 0 THEN close + gap_{t} ELSE close + gap_{t} * (100 - {t}) / {t} END") for t in (70, 30)},
    ctes=walks.RICH,
    source="c",
)

_HLC = "(high + low + close)"
SQL["r_volume"] = layered(
    [
        {"ad1": "coalesce((2 * close - high - low) / nullif(high - low, 0) * volume, 0)", "mid": _MID, "dm": "high - low", "turn": f"CASE WHEN {_HLC} > lag({_HLC}) {W} THEN 1 WHEN {_HLC} < lag({_HLC}) {W} THEN -1 END"},
        {"ad": f"sum(ad1) {SO_FAR}", "mid1": lag("mid"), "dm1": lag("dm"), "oi1": f"{lag('volume')} + 1", "trend": f"coalesce(last_value(turn IGNORE NULLS) {SO_FAR}, -1)"},
        {"flip": f"CASE WHEN i > 1 AND trend <> {lag('trend')} THEN 1 ELSE 0 END"},
        {"run": f"sum(flip) {SO_FAR}"},
        {"cm": "CASE WHEN i = 1 THEN 0 ELSE sum(CASE WHEN i > 1 THEN dm ELSE 0 END + CASE WHEN flip = 1 THEN dm1 ELSE 0 END) OVER (PARTITION BY ticker, run ORDER BY ts ROWS UNBOUNDED PRECEDING) END"},
        {"vf": "volume * abs(2 * dm / nullif(cm, 0) - 1) * trend * 100", "hp": "100 * volume * (mid - mid1) * (1 + sign(mid - mid1) * 2 * abs(volume + 1 - oi1) / nullif(least(volume + 1, oi1), 0))", "fo": f"(close - {lag('close')}) * volume"},
        {"a3": ema("ad", 3), "a10": ema("ad", 10), "hl": ema("dm", 10), "eom": wilders("(mid - mid1) * dm / nullif(volume, 0)", 14), "k34": ema("vf", 34), "k55": ema("vf", 55), "force": ema("fo", 13), "herrick": ("hp / 100000", "0.1")},
    ],
    KEYS | {"chaikin": r("a3 - a10"), "chaikin_volatility": r(f"100 * (hl / nullif({lag('hl', 10)}, 0) - 1)"), "eom": r("eom"), "klinger": r("k34 - k55"), "force": r("force"), "herrick": r("herrick")},
)

SQL["r_pivots"] = (
    f"WITH RECURSIVE {walks.NUMBERED}, {zigzag('b', 'close', 'close', 10)},"
    + f"""
ev AS (SELECT ticker, i AS seen, e_side, e_i, e_p, lag(e_p) OVER (PARTITION BY ticker, e_side ORDER BY i) AS p_p, lead(e_i) OVER (PARTITION BY ticker ORDER BY i) AS n_i, lead(e_p) OVER (PARTITION BY ticker ORDER BY i) AS n_p FROM z WHERE e_side <> 0),
hi AS (SELECT b.*, coalesce(close > lag(x) {W}, false) AS hit FROM (SELECT *, {hhv('high', 10)} AS x FROM b) b),
sp AS (SELECT ticker, i, CASE WHEN hit THEN i ELSE -99 END AS last, hit AS pass FROM hi WHERE i = 1
 UNION ALL SELECT h.ticker, h.i, CASE WHEN hit AND h.i - last > 5 THEN h.i ELSE last END, hit AND h.i - last > 5 FROM sp JOIN hi h ON h.ticker = sp.ticker AND h.i = sp.i + 1)
SELECT b.ticker, b.ts, {r('CASE WHEN l.n_i IS NOT NULL THEN l.e_p + (l.n_p - l.e_p) * (b.i - l.e_i) / (l.n_i - l.e_i) WHEN b.i = l.e_i THEN l.e_p END')} AS zigzag, {r('t.e_p')} AS peak1, {r('u.e_p')} AS trough1, {r('c.p_p')} AS peak2_causal, CAST(sp.pass AS DOUBLE) AS spaced_breaks
FROM b JOIN sp USING (ticker, i) ASOF LEFT JOIN ev l ON b.ticker = l.ticker AND b.i >= l.e_i
 ASOF LEFT JOIN (SELECT * FROM ev WHERE e_side = 1) t ON b.ticker = t.ticker AND b.i >= t.e_i
 ASOF LEFT JOIN (SELECT * FROM ev WHERE e_side = -1) u ON b.ticker = u.ticker AND b.i >= u.e_i
 ASOF LEFT JOIN (SELECT * FROM ev WHERE e_side = 1) c ON b.ticker = c.ticker AND b.i >= c.seen"""
)

_SPACED = """{into} AS (SELECT ticker, i, CASE WHEN {hit} THEN i ELSE -99 END AS last, {hit} AS pass FROM {source} WHERE i = 1
 UNION ALL SELECT s.ticker, s.i, CASE WHEN s.{hit} AND s.i - last > {n} THEN s.i ELSE last END, s.{hit} AND s.i - last > {n} FROM {into} p JOIN {source} s ON s.ticker = p.ticker AND s.i = p.i + 1)"""
_DI = walks.walk(walks.DIRECTIONAL, ctes=walks.RICH, source="c")
SQL["i_directional_signals"] = (
    f"WITH RECURSIVE {_DI}, x AS MATERIALIZED (SELECT *, coalesce(plus > minus AND {lag('plus')} <= {lag('minus')}, false) AS up, {lag('adx')} AS a1, {lag('adx', 2)} AS a2 FROM w),"
    + f" {_SPACED.format(into='sp', hit='up', source='x', n=5)}"
    + " SELECT x.ticker, x.ts, up::BIGINT AS di_cross, CASE WHEN up THEN (adx > 25)::BIGINT ELSE 0 END AS di_trend, (adx > a1 AND a1 <= a2)::BIGINT AS adx_turn, CAST(pass AS DOUBLE) AS spaced FROM x JOIN sp USING (ticker, i)"
)
_STOCH = [{"raw": f"(close - ({llv('low', 14)})) / nullif(({hhv('high', 14)}) - ({llv('low', 14)}), 0)"}, {"k14": f"100 * ({ma('raw', 3)})"}, {"d14": ma("k14", 3)}]
SQL["i_stoch_signals"] = layered(_STOCH, KEYS | {"oversold_up": f"({cross('k14', 'd14')} = 1 AND k14 < 20)::BIGINT", "overbought_down": f"({cross('d14', 'k14')} = 1 AND k14 > 80)::BIGINT"})
_AFTER = f"OVER ({SPEC} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
SQL["r_fractal_breakouts"] = layered(
    [
        {"top": f"coalesce(high = ({hhv('high', 10)}) AND count(high) {_AFTER} = 5 AND max(high) {_AFTER} < high, false)", "l5": llv("low", 5)},
        {"seen": f"last_value(CASE WHEN top THEN high END IGNORE NULLS) {SO_FAR}"},
        {"level": lag("seen", 5), "l5b": lag("l5")},
        {"buy": cross("close", "level"), "sell": "coalesce(close < l5b, false)::BIGINT"},
        {"state": f"last_value(CASE WHEN buy = 1 THEN 1 WHEN sell = 1 THEN 0 END IGNORE NULLS) {SO_FAR}"},
    ],
    KEYS | {"level": r("level"), "buy": "buy", "sell": "sell", "held": "coalesce(state, 0)"},
)
_LABEL = "CASE WHEN {a} > {b} AND {a1} <= {b1} THEN 'buy' WHEN {b} > {a} AND {b1} <= {a1} THEN 'sell' WHEN {a} > {b} THEN 'up' WHEN {a} < {b} THEN 'down' END"
_T3_OF = lambda p: "(" + " + ".join(f"{v!r} * {p}{c[1]}" for c, v in _T3.items()) + ")"
_PAIRS = {
    "rsi": ("rsi", "rsi9"), "t3": (_T3_OF("ca"), _T3_OF("cb")), "williams": ("wr", "wr9"), "double_ema": ("e5", "e20"),
    "zltema": (f"(2 * t9 - {tema_of('u')})", f"(2 * t20 - {tema_of('v')})"), "t3_rsi": (_T3_OF("ra"), _T3_OF("rb")),
}
SQL["e37_signal_labels"] = layered(
    [
        *rsi_layers({"rsi": ("close", 14)}),
        {"r14": f"-100 * (({hhv('high', 14)}) - close) / nullif(({hhv('high', 14)}) - ({llv('low', 14)}), 0)"},
        {"rsi9": ema("rsi", 9), "e5": ema("close", 5), "e20": ema("close", 20)}
        | chain("ca", "close", 3, 6) | chain("cb", "close", 5, 6) | chain("ra", "rsi", 3, 6) | chain("rb", "rsi", 8, 6) | chain("wq", "r14", 5, 2) | {"wr": same("2 * wq1 - wq2"), "wr9": ema("wr", 9)}
        | chain("s", "close", 9, 3) | {"t9": same(tema_of("s"))} | chain("u", "t9", 9, 3) | chain("y", "close", 20, 3) | {"t20": same(tema_of("y"))} | chain("v", "t20", 20, 3),
        {f"{n}_{i}": x for n, pair in _PAIRS.items() for i, x in enumerate(pair)},
        {f"{n}_{i}b": lag(f"{n}_{i}") for n in _PAIRS for i in (0, 1)},
    ],
    KEYS | {f"label_{n}": _LABEL.format(a=f"{n}_0", b=f"{n}_1", a1=f"{n}_0b", b1=f"{n}_1b") for n in _PAIRS},
)
SQL["e31_boom_volume"] = layered(
    [{"m": ma("volume", 20), "before": f"list(volume) OVER ({SPEC} ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)"}, {"ratio": f"volume / nullif({lag('m')}, 0)"}],
    KEYS | {"close": r("close"), "ratio": r("ratio"), "volume_rank": r("CASE WHEN len(before) = 50 THEN 100.0 * len(list_filter(before, lambda v: v < volume)) / 50 END"), "buy_volume": r("coalesce(volume * (close - low) / nullif(high - low, 0), volume / 2)")},
    tail="WHERE ratio > 2 AND close > open",
)
_ONE = {f"{c}{i}": lag(x, i) for c, x in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close")) for i in (1, 2)}
_flag = lambda x: f"coalesce({x}, false)::BIGINT"
SQL["k_more_candles"] = layered(
    [_ONE, {"top": "greatest(high, h1)", "bot": "least(low, l1)", "span": "high - low", "body": "abs(close - open)", "upper_": "high - greatest(open, close)", "lower_": "least(open, close) - low"}],
    KEYS
    | {"rising_window": _flag("low > h1"), "falling_window": _flag("high < l1"), "big_body": _flag("body >= 0.67 * span"), "long_shadow": _flag("upper_ >= 0.67 * span OR lower_ >= 0.67 * span")}
    | {"gapping_tasuki": _flag("l1 > h2 AND c1 > o1 AND close < open AND close < o1 AND close > h2"), "merged_hammer": "CASE WHEN o1 IS NULL THEN 0 ELSE " + _flag("least(o1, close) - bot >= 2 * abs(close - o1) AND top - greatest(o1, close) <= 0.1 * (top - bot)") + " END", "merged_body": r("100 * (close - o1) / nullif(c2, 0)")},
)


def compressed(unit: str, into: str, ctes: str = BARS_SQL) -> str:
    """``ctes`` and the bars of each week or month."""
    return f"{ctes}, {into} AS (SELECT ticker, CAST(date_trunc('{unit}', ts) AS DATE) AS ts, arg_min(open, bars.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, bars.ts) AS close, sum(volume) AS volume FROM bars GROUP BY ticker, date_trunc('{unit}', ts))"


def _mfi_sql(source: str, n: int, into: str) -> str:
    return f"""{into}_1 AS (SELECT *, (high + low + close) / 3 AS tp FROM {source}), {into}_2 AS (SELECT *, {lag('tp')} AS tp1 FROM {into}_1),
{into}_3 AS (SELECT *, CASE WHEN tp1 IS NOT NULL THEN CASE WHEN tp > tp1 THEN tp * volume ELSE 0 END END AS up, CASE WHEN tp1 IS NOT NULL THEN CASE WHEN tp < tp1 THEN tp * volume ELSE 0 END END AS dn FROM {into}_2),
{into}_4 AS (SELECT ticker, ts, {total('up', n)} AS up, {total('dn', n)} AS dn FROM {into}_3), {into} AS (SELECT ticker, ts, 100 * up / nullif(up + dn, 0) AS mfi FROM {into}_4)"""


_FRAMES = compressed("month", "months", compressed("week", "weeks"))
SQL["t_mfi_frames"] = f"""WITH {_FRAMES}, {_mfi_sql('bars', 14, 'd')}, {_mfi_sql('weeks', 6, 'w')}, {_mfi_sql('months', 6, 'm')},
j AS (SELECT d.ticker, d.ts, d.mfi AS mfi_d, w.mfi AS mfi_w, m.mfi AS mfi_m FROM d
 LEFT JOIN (SELECT ticker, ts, {lag('mfi')} AS mfi FROM w) w ON w.ticker = d.ticker AND w.ts = CAST(date_trunc('week', d.ts) AS DATE)
 LEFT JOIN (SELECT ticker, ts, {lag('mfi')} AS mfi FROM m) m ON m.ticker = d.ticker AND m.ts = CAST(date_trunc('month', d.ts) AS DATE))
SELECT ticker, ts, {r('mfi_d')} AS mfi_d, {r('mfi_w')} AS mfi_w, {r('mfi_m')} AS mfi_m, coalesce(mfi_d > 50 AND mfi_w > 50 AND mfi_m > 50, false)::BIGINT AS all_up FROM j"""


def _sentiment(unit: str, source: str) -> str:
    ctes = f"{compressed(unit, source)}, n AS MATERIALIZED (SELECT *, row_number() {W} AS i, (open + high + low + close) / 4 AS x4 FROM {source})"
    return layered([*rsi_layers({"rsi": ("x4", 8)}), *hma_layers("sent", "rsi", 4)], {"ticker": "ticker", "ts": "ts", "value": lag("sent")}, ctes=ctes, source="n")


SQL["t_sentiment_matrix"] = f"""WITH {BARS_SQL}, w AS ({_sentiment('week', 'weeks')}), m AS ({_sentiment('month', 'months')})
SELECT bars.ticker, bars.ts, {r('w.value')} AS sentiment_w, {r('m.value')} AS sentiment_m FROM bars
 LEFT JOIN w ON w.ticker = bars.ticker AND w.ts = CAST(date_trunc('week', bars.ts) AS DATE) LEFT JOIN m ON m.ticker = bars.ticker AND m.ts = CAST(date_trunc('month', bars.ts) AS DATE)"""

_HOURS = f"{INTRADAY}, hours AS (SELECT ticker, date_trunc('hour', ts) AS hour, max(high) AS high, min(low) AS low FROM intraday GROUP BY ALL), before AS (SELECT ticker, hour, lag(high) OVER o AS hour_high, lag(low) OVER o AS hour_low FROM hours WINDOW o AS (PARTITION BY ticker ORDER BY hour)), bh AS MATERIALIZED (SELECT b.*, hour_high, hour_low FROM b LEFT JOIN before ON before.ticker = b.ticker AND before.hour = date_trunc('hour', b.ts))"
SQL["e30_intraday_systems"] = layered(
    [walks.MACD, {"raw": f"(close - ({llv('low', 14)})) / nullif(({hhv('high', 14)}) - ({llv('low', 14)}), 0)", "m": ma("close", 20)}, {"k14": f"100 * ({ma('raw', 3)})"}, {"d14": ma("k14", 3)}],
    KEYS | {"hour_break": _flag("close > hour_high"), "hour_fall": _flag("close < hour_low"), "pull_back": f"coalesce(low <= m AND close > m AND m > {lag('m')}, false)::BIGINT", "macd_up": cross("macd", "signal"), "stoch_up": cross("k14", "d14")},
    ctes=_HOURS,
    source="bh",
)

# -- trailing stops: one walk with the state of all ------------------------------------------
_SEEDED = ", ".join(f"CASE WHEN i = {n} THEN avg((high + low) / 2) {over(n)} WHEN i > {n} THEN (high + low) / 2 END AS j{n}" for n in (13, 8, 5))
_BODIES = f"{walks.NUMBERED}, c AS MATERIALIZED (SELECT *, (open + high + low + close) / 4 AS hc, CASE WHEN i = 1 THEN open ELSE lag((open + high + low + close) / 4) {W} END AS hb, {_SEEDED} FROM b)"
_SMOOTHED = {"atr10": wilders("tr", 10), "atr22": wilders("tr", 22), "ho": ("hb", "0.5"), "jaw": wilders("j13", 13), "teeth": wilders("j8", 8), "lips": wilders("j5", 5)}
for _x in ("open", "high", "low", "close"):
    _SMOOTHED |= chain(f"s_{_x}", _x, 10, 2)
_DEMAS = {x: f"(2 * s_{x}1 - s_{x}2)" for x in ("open", "high", "low", "close")}
_BODIES2 = f"""{walks.walk(_SMOOTHED, ctes=_BODIES, source='c')},
d0 AS MATERIALIZED (SELECT *, {_DEMAS['open']} AS d_o, ({' + '.join(_DEMAS.values())}) / 4 AS d_c FROM w), d1 AS MATERIALIZED (SELECT *, CASE WHEN i = 1 THEN d_o ELSE {lag('d_c')} END AS hb2 FROM d0)"""
_STOPS_IN = f"""{walks.walk({'sho': ('hb2', '0.5')}, ctes=_BODIES2, source='d1', into='d2')},
k AS MATERIALIZED (SELECT *, (high + low) / 2 - 3 * atr10 AS st_up, (high + low) / 2 + 3 * atr10 AS st_dn, ({hhv('high', 22)}) - 3 * atr22 AS ch_l, ({llv('low', 22)}) + 3 * atr22 AS ch_s,
  ({hhv('close', 22)}) - 3 * atr22 AS cc_l, ({llv('close', 22)}) + 3 * atr22 AS cc_s, {lag('low')} AS low1, {lag('low', 2)} AS low2, {lag('high')} AS high1, {lag('high', 2)} AS high2 FROM d2)"""


def _exit(p: str) -> dict[str, str]:
    """State of a two-sided exit: both lines and the side, ``p_l`` and ``p_s`` being the lines of the bar itself."""
    long = f"CASE WHEN c1 > e.{p}_long THEN greatest({p}_l, e.{p}_long) ELSE {p}_l END"
    short = f"CASE WHEN c1 < e.{p}_short THEN least({p}_s, e.{p}_short) ELSE {p}_s END"
    return {f"{p}_long": long, f"{p}_short": short, f"{p}_side": f"CASE WHEN close > e.{p}_short THEN 1 WHEN close < e.{p}_long THEN -1 ELSE e.{p}_side END"}


_BEST = "CASE WHEN e.vs_side > 0 THEN greatest(e.vs_best, close) ELSE least(e.vs_best, close) END"
_TURN = f"(close - (({_BEST}) - e.vs_side * 3 * atr10)) * e.vs_side < 0"
_SAR = "e.sar + e.af * (e.ep - e.sar)"
_SAR_L, _SAR_S = f"least({_SAR}, low1, coalesce(low2, low1))", f"greatest({_SAR}, high1, coalesce(high2, high1))"
_STATE = {
    "up": ("st_up", "CASE WHEN c1 > e.up THEN greatest(st_up, e.up) ELSE st_up END"), "dn": ("st_dn", "CASE WHEN c1 < e.dn THEN least(st_dn, e.dn) ELSE st_dn END"),
    "st_side": ("1", "CASE WHEN close > e.dn THEN 1 WHEN close < e.up THEN -1 ELSE e.st_side END"),
    **{n: (n.split("_")[0] + {"long": "_l", "short": "_s"}[n.split("_")[1]] if not n.endswith("side") else "1", x) for p in ("ch", "cc") for n, x in _exit(p).items()},
    "vs_side": ("1", f"CASE WHEN {_TURN} THEN -e.vs_side ELSE e.vs_side END"), "vs_best": ("close", f"CASE WHEN {_TURN} THEN close ELSE {_BEST} END"),
    "trail": ("close - 3 * atr10", "CASE WHEN close > e.trail AND c1 > e.trail THEN greatest(e.trail, close - 3 * atr10) WHEN close < e.trail AND c1 < e.trail THEN least(e.trail, close + 3 * atr10) WHEN close > e.trail THEN close - 3 * atr10 ELSE close + 3 * atr10 END"),
    "sar_long": ("1", f"CASE WHEN e.sar_long = 1 THEN CASE WHEN low < {_SAR_L} THEN 0 ELSE 1 END ELSE CASE WHEN high > {_SAR_S} THEN 1 ELSE 0 END END"),
    "sar": ("low", f"CASE WHEN e.sar_long = 1 THEN CASE WHEN low < {_SAR_L} THEN e.ep ELSE {_SAR_L} END ELSE CASE WHEN high > {_SAR_S} THEN e.ep ELSE {_SAR_S} END END"),
    "af": ("0.02", f"CASE WHEN e.sar_long = 1 THEN CASE WHEN low < {_SAR_L} THEN 0.02 WHEN high > e.ep THEN least(0.2, e.af + 0.02) ELSE e.af END ELSE CASE WHEN high > {_SAR_S} THEN 0.02 WHEN low < e.ep THEN least(0.2, e.af + 0.02) ELSE e.af END END"),
    "ep": ("high", f"CASE WHEN e.sar_long = 1 THEN CASE WHEN low < {_SAR_L} THEN low ELSE greatest(e.ep, high) END ELSE CASE WHEN high > {_SAR_S} THEN high ELSE least(e.ep, low) END END"),
}
_DARVAS = """dv AS (SELECT ticker, i, 1 AS state, CAST(high AS DOUBLE) AS t, CAST(NULL AS DOUBLE) AS d, CAST(NULL AS DOUBLE) AS top, CAST(NULL AS DOUBLE) AS bot FROM k WHERE i = 1
 UNION ALL SELECT ticker, i, state, t, d, CASE WHEN state = 5 THEN t ELSE top END, CASE WHEN state = 5 THEN d ELSE bot END
 FROM (SELECT k.ticker, k.i, v.top, v.bot, CASE WHEN v.state = 5 THEN CASE WHEN high > t OR low < d THEN 1 ELSE 5 END WHEN high > t THEN 1 WHEN v.state < 3 THEN v.state + 1 WHEN low < d THEN 3 ELSE v.state + 1 END AS state,
   CASE WHEN v.state = 5 THEN CASE WHEN high > t OR low < d THEN high ELSE t END WHEN high > t THEN high ELSE t END AS t,
   CASE WHEN v.state = 5 THEN CASE WHEN high > t OR low < d THEN NULL ELSE d END WHEN high > t THEN NULL WHEN v.state < 3 THEN low WHEN low < d THEN low ELSE d END AS d FROM dv v JOIN k ON k.ticker = v.ticker AND k.i = v.i + 1))"""
SQL["r_stops"] = f"""WITH RECURSIVE {_STOPS_IN},
held AS (SELECT ticker, i, {', '.join(f'CAST({first} AS DOUBLE) AS {n}' for n, (first, _) in _STATE.items())} FROM k WHERE i = 1
 UNION ALL SELECT k.ticker, k.i, {', '.join(f'{x} AS {n}' for n, (_, x) in _STATE.items())} FROM held e JOIN k ON k.ticker = e.ticker AND k.i = e.i + 1), {_DARVAS}
SELECT k.ticker, k.ts, {r('CASE WHEN st_side > 0 THEN up ELSE dn END')} AS supertrend, {r('st_side')} AS supertrend_side, {r('vs_best - vs_side * 3 * atr10')} AS volatility_stop, {r('CASE WHEN ch_side > 0 THEN ch_long ELSE ch_short END')} AS chandelier,
 {r('CASE WHEN cc_side > 0 THEN cc_long ELSE cc_short END')} AS chandelier_close, {r('trail')} AS atr_trail, {r('sar')} AS sar, {r('ho')} AS ha_open, {r('hc')} AS ha_close, {r('sho')} AS smooth_ha_open, {r('dv.top')} AS darvas_top, {r('dv.bot')} AS darvas_low, {r('jaw')} AS jaw, {r('teeth')} AS teeth, {r('lips')} AS lips
FROM k JOIN held USING (ticker, i) JOIN (SELECT ticker, i, top, bot FROM dv) dv USING (ticker, i)"""

# -- bands, with the states of four trailing lines in one walk ---------------------------------
_BANDS_IN = f"""{walks.walk({'atr10': wilders('tr', 10), 'atr14': wilders('tr', 14), 'atr20': wilders('tr', 20), 'rl': ema('(high + low + 2 * close) / 4', 8), 'eh': ema('high', 5), 'el': ema('low', 5), 'ec': ema('close', 5), 'w13': wilders(_MID, 13), 'w8': wilders(_MID, 8), 'w5': wilders(_MID, 5)})},
bk AS MATERIALIZED (SELECT *, {ma('close', 20)} AS m20, {_MID} AS mid, high - 2 * atr14 AS sl, low + 2 * atr14 AS ss, eh + el + ec AS j FROM w)"""
_BAND_BEST = "CASE WHEN e.v_side > 0 THEN greatest(e.v_best, close) ELSE least(e.v_best, close) END"
_BAND_GAP = lambda side: f"(CASE WHEN {side} > 0 THEN 3 ELSE 2 END) * atr10"
_BAND_TURN = f"(close - (({_BAND_BEST}) - e.v_side * {_BAND_GAP('e.v_side')})) * e.v_side < 0"
_LINE = "CASE WHEN e.ph > 0 THEN greatest(e.line, mid - 1.5 * atr14) ELSE least(e.line, mid + 1.5 * atr14) END"
_FLIP = f"(close - ({_LINE})) * e.ph < 0"
_BAND_STATE = {
    "best": ("close", "CASE WHEN close < e.best * 0.9 THEN close ELSE greatest(e.best, close) END"),
    "ph": ("CASE WHEN close < mid - 1.5 * atr14 THEN -1 ELSE 1 END", f"CASE WHEN {_FLIP} THEN -e.ph ELSE e.ph END"),
    "line": ("CASE WHEN close < mid - 1.5 * atr14 THEN mid + 1.5 * atr14 ELSE mid - 1.5 * atr14 END", f"CASE WHEN {_FLIP} THEN mid + e.ph * 1.5 * atr14 ELSE {_LINE} END"),
    "v_side": ("1", f"CASE WHEN {_BAND_TURN} THEN -e.v_side ELSE e.v_side END"), "v_best": ("close", f"CASE WHEN {_BAND_TURN} THEN close ELSE {_BAND_BEST} END"),
}
SQL["r_bands"] = f"""WITH RECURSIVE {_BANDS_IN},
held AS (SELECT ticker, i, {', '.join(f'CAST({first} AS DOUBLE) AS {n}' for n, (first, _) in _BAND_STATE.items())} FROM bk WHERE i = 1
 UNION ALL SELECT bk.ticker, bk.i, {', '.join(f'{x} AS {n}' for n, (_, x) in _BAND_STATE.items())} FROM held e JOIN bk ON bk.ticker = e.ticker AND bk.i = e.i + 1)
SELECT bk.ticker, bk.ts, {r('m20 + 2 * atr20')} AS keltner_top, {r('m20 - 2 * atr20')} AS keltner_low, {r('m20 + 1.618 * atr20')} AS fib_top1, {r('m20 - 4.236 * atr20')} AS fib_low3,
 {r(f'({hhv("rl", 60)})')} AS range_top, {r(f'({llv("rl", 60)})')} AS range_low, {r(f'({hhv("sl", 10)})')} AS stoploss_long, {r(f'({llv("ss", 10)})')} AS stoploss_short, {r(f'({total("j", 5)}) / 15')} AS jnsar,
 {r('best * 0.9')} AS percent_trail, {r('line')} AS phase_line, {r(lag('w13', 8))} AS jaw, {r(lag('w8', 5))} AS teeth, {r(lag('w5', 3))} AS lips, {r(f"v_best - v_side * {_BAND_GAP('v_side')}")} AS asymmetric_stop
FROM (SELECT bk.*, best, ph, line, v_side, v_best FROM bk JOIN held USING (ticker, i)) bk"""

_MAD_LISTS = {f"w{n}": f"list(x3) {over(n)}" for n in (14, 25, 50)}
_CCI = " + ".join(f"(x3 - a{n}) / nullif(0.015 * mad{n}, 0) / 3" for n in (14, 25, 50))
SQL["r_smoothed"] = layered(
    [
        {"x3": "(high + low + close) / 3", "m4": "(high + low + 2 * close) / 4", "sg": f"coalesce(sign(close - {lag('close')}), 0) * volume", "share": "coalesce((close - low) / nullif(high - low, 0), 0.5)", "r14": f"-100 * (({hhv('high', 14)}) - close) / nullif(({hhv('high', 14)}) - ({llv('low', 14)}), 0)"},
        _MAD_LISTS | {f"a{n}": ma("x3", n) for n in (14, 25, 50)} | {"sd4": full("stddev_pop({x}) {w}", "m4", 20)},
        {f"mad{n}": f"CASE WHEN a{n} IS NOT NULL THEN list_avg(list_transform(w{n}, lambda v: abs(v - a{n}))) END" for n in (14, 25, 50)},
        *rsi_layers({"rsi": ("close", 14)}),
        {"cci": _CCI, "rc": "rsi - 50", "gap": "13 * (l_rsi * 70 / 30.0 - g_rsi)"},
        {"cc5": ema("cci", 5)} | chain("wq", "r14", 5, 2) | {"m4e": ema("m4", 20), "fl1": ema("(m4 - m4e) / nullif(sd4, 0)", 5), "fl": ema("fl1", 3), "ve": ema("sg", 13), "vv": ema("volume", 13)} | chain("bu", "volume * share", 9, 3) | chain("be", "volume * (1 - share)", 9, 3),
        {"p70": "CASE WHEN gap >= 0 THEN close + gap ELSE close + gap * 30.0 / 70 END"},
    ],
    KEYS
    | {"multiple_cci": r("cc5"), "zero_lag_r": r("2 * wq1 - wq2"), "flower": r("fl"), "rsi_top": r(f"50 + 0.8 * ({hhv('rc', 50)})"), "rsi_low": r(f"50 + 0.8 * ({llv('rc', 50)})")}
    | {"projection_70": r("CASE WHEN p70 >= close THEN ceil(p70 / 0.1 - 1e-9) ELSE floor(p70 / 0.1 + 1e-9) END * 0.1"), "volume_explosion": r("100 * ve / nullif(vv, 0)"), "bull_volume": r(tema_of("bu")), "bear_volume": r(tema_of("be"))},
)
_MIDS = {f"r{n}": f"(({hhv('high', n)}) + ({llv('low', n)})) / 2" for n in (*range(3, 16, 3), *range(30, 61, 10))}
_SHORT, _LONG = (", ".join(f"r{n}" for n in s) for s in (range(3, 16, 3), range(30, 61, 10)))
_ALL_MIDS = " AND ".join(f"{n} IS NOT NULL" for n in _MIDS)
SQL["v_states"] = layered(
    [
        walks.DIRECTIONAL | walks.RSI | {"atr": wilders("tr", 14)},
        _MIDS | {"h20": hhv("high", 20), "l20": llv("low", 20), "h5": hhv("high", 5), "l5": llv("low", 5), "v1": lag("volume"), "n_left": "i - max(i) OVER (PARTITION BY ticker)", "open1": "first(open) OVER (PARTITION BY ticker, date_trunc('month', ts) ORDER BY ts ROWS UNBOUNDED PRECEDING)"},
        {"h20b": lag("h20"), "l20b": lag("l20"), "h5b": lag("h5"), "l5b": lag("l5"), "inside": "CASE WHEN n_left > -50 THEN close END"},
        {"sw": f"last_value(CASE WHEN close > h20b THEN l5 WHEN close < l20b THEN h5 END IGNORE NULLS) {SO_FAR}", "state": f"coalesce(last_value(CASE WHEN close > h5b THEN 1 WHEN close < l5b THEN -1 END IGNORE NULLS) {SO_FAR}, 0)"}
        | {n: f"{g}(inside, i) OVER (PARTITION BY ticker)" for n, g in (("slope", "regr_slope"), ("cut", "regr_intercept"))},
        {"line": "CASE WHEN inside IS NOT NULL THEN cut + slope * i END", "same": f"coalesce(state = {lag('state')}, false)"},
        {"err": "sqrt(sum((inside - line) * (inside - line)) OVER (PARTITION BY ticker) / nullif(count(inside) OVER (PARTITION BY ticker) - 2, 0))", "since": f"last_value(CASE WHEN NOT same THEN i END IGNORE NULLS) {SO_FAR}"},
    ],
    KEYS
    | {"rsi_zone": "CASE " + " ".join(f"WHEN rsi <= {t} THEN 'to {t}'" for t in range(20, 81, 10)) + " WHEN rsi IS NOT NULL THEN 'over 80' END", "trend_strength": "CASE WHEN adx < 20 THEN 'none' WHEN adx < 25 THEN 'weak' WHEN adx < 40 THEN 'trending' WHEN adx < 60 THEN 'strong' WHEN adx IS NOT NULL THEN 'extreme' END"}
    | {"ribbon_up": f"coalesce(least({_SHORT}) > greatest({_LONG}), false)::BIGINT", "ribbon_down": f"coalesce(greatest({_SHORT}) < least({_LONG}), false)::BIGINT", "swing_stop": r("sw"), "latched": "state", "latched_bars": "coalesce(i - since, i)", "trigger_up": r("open1 + 0.5 * atr"), "trigger_down": r("open1 - 0.5 * atr")}
    | {"interest": "CASE WHEN close > c1 AND volume > v1 THEN 'long build-up' WHEN NOT close > c1 AND volume > v1 THEN 'short build-up' WHEN close > c1 AND NOT volume > v1 THEN 'short covering' WHEN NOT close > c1 AND NOT volume > v1 THEN 'long unwinding' ELSE '' END"}
    | {f"target_{n}": r(f"close + {n} * 2 * atr") for n in (1, 2, 3)}
    | {"risk_percent": r("100 * 2 * atr / close"), "channel": r("line"), "channel_top": r("line + 2 * err"), "channel_low": r("line - 2 * err")},
    ctes=walks.RICH,
    source="c",
)

# -- every indicator of the selector, 14 bars --------------------------------------------------
_W14, _W7 = weighted("close", 14), weighted("close", 7)
_ALMA14 = [exp(-((k - 0.85 * 13) ** 2) / (2 * (14 / 6) ** 2)) for k in range(14)]
SQL["r_selected"] = layered(
    [
        {"x3": "(high + low + close) / 3", "m4": "(high + low + 2 * close) / 4", "mid": _MID, "dm": "high - low", "turn": f"CASE WHEN {_HLC} > lag({_HLC}) {W} THEN 1 WHEN {_HLC} < lag({_HLC}) {W} THEN -1 END", "w14": _W14, "hraw": f"2 * {_W7} - {_W14}",
         "sm14": f"CASE WHEN i = 14 THEN avg(close) {over(14)} WHEN i > 14 THEN close END", "off": f"close - ({ma('close', 14)})", "raw": f"(close - ({llv('low', 14)})) / nullif(({hhv('high', 14)}) - ({llv('low', 14)}), 0)"},
        *rsi_layers({"rsi": ("close", 14)}),
        {"trend": f"coalesce(last_value(turn IGNORE NULLS) {SO_FAR}, -1)", "dm1": lag("dm"), "mid1": lag("mid"), "d5": f"close - {lag('close', 5)}", "d14": f"close - {lag('close', 14)}", "root": f"sqrt((close - {lag('close')}) * (close - {lag('close')}) + 1)", "vp": f"abs(high - {lag('low')})", "vm": f"abs(low - {lag('high')})",
         "tr14": total("tr", 14), "sd4": full("stddev_pop({x}) {w}", "m4", 14), "srsi": stoch("rsi", 14), "k14": f"100 * ({ma('raw', 3)})", "zz": f"(off - ({ma('off', 14)})) / nullif(({full('stddev_pop({x}) {w}', 'off', 14)}), 0)", "fo": f"(close - {lag('close')}) * volume", "sg": f"coalesce(sign(close - {lag('close')}), 0) * volume"},
        {"flip": f"CASE WHEN i > 1 AND trend <> {lag('trend')} THEN 1 ELSE 0 END", "vp14": total("vp", 14), "vm14": total("vm", 14), "path": total("root", 14)},
        {"run": f"sum(flip) {SO_FAR}", "vxp": "vp14 / nullif(tr14, 0)", "vxm": "vm14 / nullif(tr14, 0)"},
        {"cm": "CASE WHEN i = 1 THEN 0 ELSE sum(CASE WHEN i > 1 THEN dm ELSE 0 END + CASE WHEN flip = 1 THEN dm1 ELSE 0 END) OVER (PARTITION BY ticker, run ORDER BY ts ROWS UNBOUNDED PRECEDING) END"},
        {"vf": "volume * abs(2 * dm / nullif(cm, 0) - 1) * trend * 100"},
        walks.DIRECTIONAL | {"u5": wilders("CASE WHEN d5 IS NOT NULL THEN greatest(d5, 0) END", 14), "n5": wilders("CASE WHEN d5 IS NOT NULL THEN greatest(-d5, 0) END", 14)} | chain("tx", "close", 14, 3) | {"e28": ema("close", 28), "atr": wilders("tr", 14)}
        | {"vadx": wilders("100 * abs(vxp - vxm) / nullif(vxp + vxm, 0)", 14), "mi1": ema("dm", 9), "mi2": ema("mi1", 9), "force": ema("fo", 14), "eom": wilders("(mid - mid1) * dm / nullif(volume, 0)", 14), "m4e": ema("m4", 14), "fl1": ema("(m4 - m4e) / nullif(sd4, 0)", 5), "fl": ema("fl1", 3)}
        | {"f23": ema("close", 23), "f50": ema("close", 50), "pe": ema("sign(d14) * 100 * sqrt(d14 * d14 + 196) / nullif(path, 0)", 5), "k1": ema("vf", 14), "k2": ema("vf", 28), "tp1": ema("zz", 20), "tp2": ema("tp1", 20), "ve": ema("sg", 14), "vv": ema("volume", 14)}
        | {"ap": same("x3"), "esa": ema("ap", 14), "dev": ema("abs(ap - esa)", 14), "wt": ema("(ap - esa) / nullif(0.015 * dev, 0)", 21), "wil": wilders("close", 14), "smma": wilders("sm14", 14)} | chain("f", "close", 14, 6) | {"t": same(tema_of("f"))} | chain("t", "t", 14, 3),
        {"ratio": "mi1 / nullif(mi2, 0)", "mx": "f23 - f50"},
        {"sc1": stoch("mx", 14)},
        {"sc1f": f"last_value(sc1 IGNORE NULLS) {SO_FAR}"},
        {"p1": ("sc1f", "0.5")},
        {"sc2": stoch("p1", 14)},
        {"sc2f": f"last_value(sc2 IGNORE NULLS) {SO_FAR}"},
        {"schaff": ("sc2f", "0.5")},
    ],
    KEYS
    | {"rsi": r("rsi"), "rmi": r("100 * u5 / nullif(u5 + n5, 0)"), "trix": r(f"100 * (tx3 / nullif({lag('tx3')}, 0) - 1)"), "stoch_k": r("k14"), "stoch_d": r(ma("k14", 3)), "macd": r("tx1 - e28"), "atr": r("atr"), "adx": r("adx"), "plus_di": r("plus"), "minus_di": r("minus"), "vortex_adx": r("vadx")}
    | {"mass": r(total("ratio", 14)), "force": r("force"), "eom": r("eom"), "flower": r("fl"), "schaff": r("schaff"), "efficiency": r("pe"), "stoch_rsi": r(ma("srsi", 3)), "klinger": r("k1 - k2"), "wave_trend": r("wt"), "two_poles": r("tp2"), "volume_explosion": r("100 * ve / nullif(vv, 0)")}
    | {"average_simple": r(ma("close", 14)), "average_ema": r("f1"), "average_wilders": r("wil"), "average_dema": r("2 * f1 - f2"), "average_tema": r("t"), "average_wma": r("w14"), "average_dwma": r(f"2 * w14 - {weighted('w14', 14)}"), "average_hma": r(weighted("hraw", 3)), "average_alma": r(weighted("close", 14, _ALMA14))}
    | {"average_t3": r(" + ".join(f"{v!r} * {c}" for c, v in _T3.items())), "average_zltema": r(f"2 * t - {tema_of('t')}"), "average_zlma": r("2 * f1 - f2"), "average_smma": r("smma")},
    ctes=walks.RICH,
    source="c",
)

# -- cointegration with the index: least squares, then the residuals' regression in closed form --
SQL["z_cointegration"] = f"""WITH {BARS_SQL}, ix AS (SELECT ts, sum(close * volume) / sum(volume) AS x FROM bars GROUP BY ts),
p AS (SELECT ticker, ts, close AS y, x FROM bars JOIN ix USING (ts)),
o AS (SELECT ticker, regr_slope(y, x) AS ratio, regr_intercept(y, x) AS cut, count(*) AS n, max(x) - min(x) AS span FROM p GROUP BY ticker),
e AS (SELECT p.ticker, p.ts, y - ratio * x - cut AS e FROM p JOIN o USING (ticker)),
d AS (SELECT ticker, ts, {lag('e')} AS e1, e - {lag('e')} AS de FROM e), m AS (SELECT *, {lag('de')} AS d1 FROM d),
s AS (SELECT ticker, sum(e1 * e1) AS a, sum(e1 * d1) AS b, sum(d1 * d1) AS c, sum(e1 * de) AS u, sum(d1 * de) AS v, sum(de * de) AS w, count(*) AS k FROM m WHERE d1 IS NOT NULL GROUP BY ticker),
f AS (SELECT ticker, (c * u - b * v) / nullif(a * c - b * b, 0) AS g0, (a * v - b * u) / nullif(a * c - b * b, 0) AS g1, c / nullif(a * c - b * b, 0) AS inv, * EXCLUDE (ticker) FROM s)
SELECT ticker, {r('CASE WHEN n >= 11 AND span > 0 THEN ratio END')} AS ratio, {r('CASE WHEN n >= 11 AND span > 0 THEN cut END')} AS intercept,
 {r('CASE WHEN n >= 11 AND span > 0 THEN g0 / sqrt((w - g0 * u - g1 * v) / greatest(1, k - 2) * inv) END')} AS t_value FROM o LEFT JOIN f USING (ticker)"""
