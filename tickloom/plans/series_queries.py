"""Queries of the bar-series primitives, averages, oscillators, bands and volume measures that are window expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import recur as k
from tickloom.functions.frame import Frame
from tickloom.operators import indicators as ind
from tickloom.operators.scan import scan
from tickloom.plans.bars import bars_eod
from tickloom.plans.sqltext import KEYS, SO_FAR, SPEC, W, div, full, hhv, lag, llv, ma, over, r, rounded, staged, total

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(make):
        QUERIES[name] = make
        if sql:
            SQL[name] = sql
        return make

    return register


def framed(spark, d) -> Frame:
    return Frame(bars_eod(spark, d))


def out(f: Frame, columns: dict, digits: int = 4, **other: int) -> DataFrame:
    """Ticker, ts and the columns; doubles rounded to ``digits``, or as ``other`` says by name."""
    return tidy(f.add(**columns).df.select("ticker", "ts", *columns), digits, **other)


def tidy(df: DataFrame, digits: int = 4, **other: int) -> DataFrame:
    def one(name: str, kind: str):
        if kind == "double":
            return rounded(F.col(name), other.get(name, digits)).alias(name)
        return F.col(name).cast("long").alias(name) if kind in ("boolean", "int") else F.col(name)

    return df.select(*[one(*c) for c in df.dtypes])


@query("bars_eod", staged([], KEYS | {x: r(x) for x in ("open", "high", "low", "close")} | {"volume": "volume"}))
def _(spark, d):
    return out(framed(spark, d), {x: F.col(x) for x in ("open", "high", "low", "close", "volume")})


@query(
    "b_extremes_sums",
    staged([], KEYS | {
        "ref_back": r(lag("close", 3)), "ref_ahead": r(f"lead(close, 2) {W}"), "hhv20": r(hhv("high", 20)), "llv20": r(llv("low", 20)), "highest": r(f"max(high) {SO_FAR}"), "lowest": r(f"min(low) {SO_FAR}"), "bar": f"row_number() {W} - 1",
        "cum_volume": f"CAST(sum(volume) {SO_FAR} AS BIGINT)", "sum10": f"CAST({total('volume', 10)} AS BIGINT)", "roc5": r("100 * (close / " + lag("close", 5) + " - 1)"), "mom5": r(f"close - {lag('close', 5)}"),
        "future_high": r(f"CASE WHEN count(high) OVER ({SPEC} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) = 5 THEN max(high) OVER ({SPEC} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) END"), "last_close": r("last_value(close) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    }),
)
def _(spark, d):
    f = framed(spark, d)
    return out(f, {"ref_back": f.ref("close", -3), "ref_ahead": f.ref("close", 2), "hhv20": f.hhv("high", 20), "llv20": f.llv("low", 20), "highest": f.highest("high"), "lowest": f.lowest("low"), "bar": f.bar(), "cum_volume": f.cum("volume"), "sum10": f.sum("volume", 10), "roc5": f.roc("close", 5), "mom5": f.momentum("close", 5), "future_high": f.future("high", 5), "last_close": f.last_value("close")})


_UP = "coalesce(close > 1.05 * " + lag("close") + ", false)"


@query(
    "b_events",
    staged(
        [{"i": f"row_number() {W} - 1", "up": _UP, "gap_u": f"coalesce(low > {lag('high')}, false)", "gap_d": f"coalesce(high < {lag('low')}, false)"},
         {"n_up": f"sum(up::INT) {SO_FAR}"},
         {"since_high": f"max(close) OVER (PARTITION BY ticker, n_up ORDER BY ts ROWS UNBOUNDED PRECEDING)"}],
        KEYS | {
            "hhvbars": f"CASE WHEN count(high) {over(20)} >= 20 THEN i - arg_max(i, row(high, i)) {over(20)} END", "llvbars": f"CASE WHEN count(low) {over(20)} >= 20 THEN i - arg_min(i, row(low, -i)) {over(20)} END",
            "highestbars": f"i - arg_max(i, row(high, i)) {SO_FAR}", "since": f"i - last_value(CASE WHEN up THEN i END IGNORE NULLS) {SO_FAR}", "when1": r(f"last_value(CASE WHEN up THEN close END IGNORE NULLS) {SO_FAR}"),
            "when0": r(f"first_value(CASE WHEN up THEN close END IGNORE NULLS) OVER ({SPEC} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"), "high_since": r("CASE WHEN n_up > 0 THEN since_high END"), "gap_up": "gap_u::BIGINT", "gap_down": "gap_d::BIGINT",
        },
    ),
)
def _(spark, d):
    f = framed(spark, d)
    up = f.hold(F.coalesce(F.col("close") > 1.05 * f.ref("close", -1), F.lit(False)))
    return out(f, {"hhvbars": f.hhvbars("high", 20), "llvbars": f.llvbars("low", 20), "highestbars": f.highestbars("high"), "since": f.bars_since(up), "when1": f.value_when(up, "close"), "when0": f.value_when(up, "close", 0), "high_since": f.since(up, "close"), "gap_up": f.gap_up(), "gap_down": f.gap_down()})


@query(
    "b_value_when_second",
    staged([{"up": _UP}], KEYS | {"when2": r(f"last_value(CASE WHEN up THEN v END IGNORE NULLS) {SO_FAR}")}, source="bars", tail="") .replace("FROM s1 ", "FROM (SELECT *, CASE WHEN up THEN lag(close) OVER (PARTITION BY ticker, up ORDER BY ts) END AS v FROM s1 WHERE true)").replace("CASE WHEN up THEN v END IGNORE NULLS", "CASE WHEN up AND v IS NOT NULL THEN v END IGNORE NULLS"),
)
def _(spark, d):
    f = framed(spark, d)
    up = f.hold(F.coalesce(F.col("close") > 1.05 * f.ref("close", -1), F.lit(False)))
    return out(f, {"when2": f.value_when(up, "close", 2)})


_I = {"i": f"CAST(row_number() {W} - 1 AS DOUBLE)"}


def _full2(agg: str, n: int) -> str:
    return full(agg, "close", n)


_SLOPE, _CUT = "regr_slope(close, i) {w}", "regr_intercept(close, i) {w}"


@query(
    "b_statistics",
    staged(
        [_I, {"slope": _full2(_SLOPE, 20), "cut": _full2(_CUT, 20), "sxy": _full2("regr_sxy(close, i) {w}", 20), "syy": _full2("regr_syy(close, i) {w}", 20)}],
        KEYS | {"sd": r(_full2("stddev_pop({x}) {w}", 20), 3), "sd_sample": r(_full2("stddev_samp({x}) {w}", 20), 3), "corr": r(_full2("covar_pop(close, CAST(volume AS DOUBLE)) {w} / nullif(stddev_pop(close) {w} * stddev_pop(CAST(volume AS DOUBLE)) {w}, 0)", 20), 3), "slope": r("slope", 3), "linreg": r("cut + slope * i", 3), "forecast": r("cut + slope * (i + 1)", 3), "stderr": r("CASE WHEN syy IS NOT NULL THEN sqrt(greatest(0, syy - slope * sxy) / 18) END", 2), "angle": r("degrees(atan(slope))", 2)},
    ),
)
def _(spark, d):
    steps = {"sd": lambda b: k.stdev(b.c, 20), "sd_sample": lambda b: k.stdev(b.c, 20, False), "corr": lambda b: k.corr(b.c, b.v, 20), "slope": lambda b: k.slope(b.c, 20), "linreg": lambda b: k.linreg(b.c, 20), "forecast": lambda b: k.linreg(b.c, 20, 1), "stderr": lambda b: k.stderr(b.c, 20), "angle": lambda b: np.degrees(np.arctan(k.slope(b.c, 20)))}
    return tidy(scan(bars_eod(spark, d).select("ticker", "ts", "close", "volume"), steps, keep=("ticker", "ts")), 3, stderr=2, angle=2)


_A, _B = f"coalesce(close > {lag('hh')}, false)", f"coalesce(close < {lag('ll')}, false)"


@query(
    "b_signals",
    staged(
        [{"hh": hhv("high", 10), "ll": llv("low", 10)}, {"a": _A, "b": _B, "m5": ma("close", 5), "m20": ma("close", 20)},
         {"grp": f"coalesce(sum(b::INT) OVER ({SPEC} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)", "state": "CASE WHEN a THEN 1 WHEN b THEN 0 END", "m5b": lag("m5"), "m20b": lag("m20"), "i": f"row_number() {W}", "last_not": f"max(CASE WHEN NOT a THEN 1 END) {W}"},
         {"nth": "sum(a::INT) OVER (PARTITION BY ticker, grp ORDER BY ts ROWS UNBOUNDED PRECEDING)", "last_no": f"max(CASE WHEN NOT a THEN i ELSE 0 END) {SO_FAR}"}],
        KEYS | {"a": "a::BIGINT", "b": "b::BIGINT", "exrem": "(a AND nth = 1)::BIGINT", "flip": f"coalesce(last_value(state IGNORE NULLS) {SO_FAR}, 0)::BIGINT", "crossed": "coalesce(m5 > m20 AND m5b <= m20b, false)::BIGINT", "quiet": f"(a AND coalesce(max(a::INT) OVER ({SPEC} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) = 0)::BIGINT", "run": "i - last_no"},
    ),
)
def _(spark, d):
    f = framed(spark, d)
    hh, ll = f.hold(f.hhv("high", 10)), f.hold(f.llv("low", 10))
    a, b = f.hold(F.coalesce(F.col("close") > f.ref(hh, -1), F.lit(False))), f.hold(F.coalesce(F.col("close") < f.ref(ll, -1), F.lit(False)))
    m5, m20 = f.hold(f.ma("close", 5)), f.hold(f.ma("close", 20))
    return out(f, {"a": a, "b": b, "exrem": f.exrem(a, b), "flip": f.flip(a, b), "crossed": f.cross(m5, m20), "quiet": f.quiet(a), "run": f.run_length(a)})


def _wma(x: str, n: int) -> str:
    terms = " + ".join(f"{n - k} * lag({x}, {k}) {W}" for k in range(n))
    return f"({terms}) / {n * (n + 1) / 2}"


@query(
    "a_averages",
    staged(
        [{"ma20": ma("close", 20), "ma50": ma("close", 50), "ma200": ma("close", 200), "w9": _wma("close", 9), "w4": _wma("close", 4)}, {"mix": "2 * w4 - w9", "w9w": _wma("w9", 9)}],
        KEYS | {"ma20": r("ma20"), "wma9": r("w9"), "dwma9": r("2 * w9 - w9w"), "hma9": r(_wma("mix", 3)), "away": r("100 * (close - ma20) / ma20"), "nearest_ma": "CASE WHEN ma50 IS NOT NULL THEN CASE WHEN close < ma20 AND close < ma50 THEN 0 WHEN abs(close - ma20) <= abs(close - ma50) THEN 20 ELSE 50 END END::BIGINT", "above_long": "CASE WHEN ma200 IS NOT NULL THEN (close > ma200)::BIGINT END"},
    ),
)
def _(spark, d):
    f = framed(spark, d)
    columns = {"ma20": f.ma("close", 20), "wma9": f.wma("close", 9), "dwma9": ind.double_wma(f, "close", 9), "hma9": ind.hull(f, "close", 9), "away": ind.distance_from_ma(f, 20), **ind.nearest_ma(f)}
    return out(f, columns)


_TP = "(high + low + close) / 3"
_TR = f"greatest(high, coalesce({lag('close')}, high)) - least(low, coalesce({lag('close')}, low))"


@query(
    "i_oscillators",
    staged(
        [{"hh": hhv("high", 14), "ll": llv("low", 14), "tp": _TP, "c1": lag("close"), "h9": hhv("high", 9), "l9": llv("low", 9), "i": f"row_number() {W} - 1", "m11": ma("close", 20), "mid": "(high + low) / 2", "up1": f"(close > {lag('close')})::INT::DOUBLE"},
         {"k0": "100 * " + div("close - ll", "hh - ll"), "j0": "100 * " + div("close - l9", "h9 - l9"), "tp1": lag("tp"), "bp": "close - least(low, coalesce(c1, low))", "tr": "greatest(high, coalesce(c1, high)) - least(low, coalesce(c1, low))", "mtp": ma("tp", 14), "win": f"list(tp) {over(14)}", "ao": f"{ma('mid', 5)} - ({ma('mid', 34)})"},
         {"up": "CASE WHEN tp1 IS NOT NULL THEN CASE WHEN tp > tp1 THEN tp * volume ELSE 0 END END", "dn": "CASE WHEN tp1 IS NOT NULL THEN CASE WHEN tp < tp1 THEN tp * volume ELSE 0 END END", "kdj_k": ma("j0", 3), "u7": div(total("bp", 7), total("tr", 7)), "u14": div(total("bp", 14), total("tr", 14)), "u28": div(total("bp", 28), total("tr", 28)), "mad": "list_sum(list_transform(win, lambda x: abs(x - mtp))) / 14", "ac": f"ao - ({ma('ao', 5)})"},
         {"gain": total("up", 14), "loss": total("dn", 14), "kdj_d": ma("kdj_k", 3)}],
        KEYS | {
            "stoch_k": r(ma("k0", 3)), "kdj_k": r("kdj_k"), "kdj_d": r("kdj_d"), "kdj_j": r("3 * kdj_k - 2 * kdj_d"), "cci": r(div("tp - mtp", "0.015 * mad"), 3), "mfi": r("100 * " + div("gain", "gain + loss")), "williams": r("-100 * " + div("hh - close", "hh - ll")), "ultimate": r("100 * (4 * u7 + 2 * u14 + u28) / 7"),
            "dpo": r(f"close - {lag('m11', 11)}"), "aroon_up": r(f"CASE WHEN count(high) {over(15)} >= 15 THEN 100.0 * (14 - (i - arg_max(i, row(high, i)) {over(15)})) / 14 END"), "aroon_down": r(f"CASE WHEN count(low) {over(15)} >= 15 THEN 100.0 * (14 - (i - arg_min(i, row(low, -i)) {over(15)})) / 14 END"), "psych": r("100 * (" + ma("up1", 12) + ")"), "position": r("k0"), "ao": r("ao"), "ac": r("ac"),
        },
    ),
)
def _(spark, d):
    steps = {
        "stoch_k": k.stoch_k, **{n: (lambda b, i=i: b.once(k.kdj)[i]) for i, n in enumerate(("kdj_k", "kdj_d", "kdj_j"))}, "cci": k.cci, "mfi": k.mfi, "williams": k.williams, "ultimate": k.ultimate, "dpo": k.dpo,
        **{n: (lambda b, i=i: b.once(k.aroon)[i]) for i, n in enumerate(("aroon_up", "aroon_down"))}, "psych": k.psychological, "position": k.range_position, **{n: (lambda b, i=i: b.once(k.awesome)[i]) for i, n in enumerate(("ao", "ac"))},
    }
    return tidy(scan(bars_eod(spark, d).drop("open"), steps, keep=("ticker", "ts")), cci=3)


def _roc(n: int) -> str:
    return f"100 * (close / {lag('close', n)} - 1)"


@query(
    "i_momentum",
    staged(
        [{"r10": _roc(10), "r15": _roc(15), "r20": _roc(20), "r30": _roc(30), "r65": _roc(65), "r130": _roc(130), "r260": _roc(260), "tr": _TR, **{f"h{n}": lag("high", n) for n in range(1, 9)}, **{f"l{n}": lag("low", n) for n in range(1, 9)}},
         {f"t{n}": f"({ma('tr', n)}) * sqrt({n})" for n in range(2, 10)}],
        KEYS | {"kst": r(f"{ma('r10', 10)} + 2 * ({ma('r15', 10)}) + 3 * ({ma('r20', 10)}) + 4 * ({ma('r30', 15)})"), "rsw": r("0.4 * r65 + 0.3 * r130 + 0.3 * r260"), "rwi_high": r("greatest(" + ", ".join(div(f"high - l{n - 1}", f"t{n}") for n in range(2, 10)) + ")"), "rwi_low": r("greatest(" + ", ".join(div(f"h{n - 1} - low", f"t{n}") for n in range(2, 10)) + ")")},
    ),
)
def _(spark, d):
    f = framed(spark, d)
    return out(f, {"kst": ind.kst(f), "rsw": ind.weighted_roc(f), **ind.random_walk(f)})


@query("i_swing_and_runs")
def _(spark, d):
    f = framed(spark, d)
    tcf = ind.trend_continuation(f)
    return out(f, {"asi": ind.swing_index(f), **tcf, "percent_rank": f.percent_rank("close", 60)}, asi=2, tcf_plus=2, tcf_minus=2)


@query(
    "v_bands",
    staged(
        [{"m": ma("close", 20), "s": full("stddev_pop({x}) {w}", "close", 20), "hc22": hhv("close", 22), "hc14": hhv("close", 14), "lr": f"ln(close / {lag('close')})", "h9": f"({hhv('high', 9)} + {llv('low', 9)}) / 2", "h26": f"({hhv('high', 26)} + {llv('low', 26)}) / 2", "h52": f"({hhv('high', 52)} + {llv('low', 52)}) / 2"},
         {"dd2": "pow(100 * (close - hc14) / hc14, 2)", "mid92": "(h9 + h26) / 2"}],
        KEYS | {"hv": r("100 * (" + full("stddev_samp({x}) {w}", "lr", 20) + ") * sqrt(252)", 3), "vix_fix": r("100 * (hc22 - low) / hc22"), "ulcer": r(f"sqrt({ma('dd2', 14)})", 3), "bb_top": r("m + 2.0 * s", 3), "bb_mid": r("m", 3), "bb_low": r("m - 2.0 * s", 3), "bb_width": r(div("m + 2.0 * s - (m - 2.0 * s)", "m"), 3), "env_top": r("m * 1.05"), "env_low": r("m * 0.95"), "tenkan": r("h9"), "kijun": r("h26"), "span_a": r(lag("mid92", 26)), "span_b": r(lag("h52", 26))},
    ),
)
def _(spark, d):
    f = framed(spark, d)
    b, i = ind.bollinger(f), ind.ichimoku(f)
    three = {"hv": ind.historical_volatility(f), "ulcer": ind.ulcer(f), **{k: b[k] for k in ("bb_top", "bb_mid", "bb_low", "bb_width")}}
    return out(f, {**three, "vix_fix": ind.vix_fix(f), **ind.envelope(f), **{k: i[k] for k in ("tenkan", "kijun", "span_a", "span_b")}}, **dict.fromkeys(three, 3))


@query(
    "v_levels",
    staged(
        [{"h20": hhv("high", 20), "l20": llv("low", 20), "h120": hhv("high", 120), "l120": llv("low", 120), "hb": f"{lag('high')}", "lb": lag("low"), "cb": lag("close")}, {"h20b": lag("h20"), "l20b": lag("l20"), "p": "(hb + lb + cb) / 3"}],
        KEYS | {"high_20": r("h20"), "low_20": r("l20"), "high_120": r("h120"), "low_120": r("l120"), "close_20": r(lag("close", 20)), "below_high_20": r("100 * (close - h20) / h20"), "above_low_20": r("100 * (close - l20) / l20"), "break_up_20": "coalesce(close > h20b, false)::BIGINT", "break_down_20": "coalesce(close < l20b, false)::BIGINT", "pivot": r("p"), "r1": r("2 * p - lb"), "s1": r("2 * p - hb"), "cam_r3": r("cb + (hb - lb) * 1.1 / 4"), "cam_s4": r("cb - (hb - lb) * 1.1 / 2")},
    ),
)
def _(spark, d):
    f = framed(spark, d)
    p, b, dd = ind.pivots_of(f.hold(f.ref("high", -1)), f.hold(f.ref("low", -1)), f.hold(f.ref("close", -1))), ind.breakout(f, 20), ind.distances(f, (20,))
    e = ind.period_extremes(f, (20, 120))
    return out(f, {**{k: e[k] for k in ("high_20", "low_20", "high_120", "low_120", "close_20")}, **dd, "break_up_20": b["break_up_20"], "break_down_20": b["break_down_20"], **{k: p[k] for k in ("pivot", "r1", "s1", "cam_r3", "cam_s4")}})


@query("v_ichimoku_signals")
def _(spark, d):
    f = framed(spark, d)
    return out(f, ind.ichimoku_signals(f))


@query(
    "f_volume",
    staged(
        [{"c1": lag("close"), "v1": lag("volume"), "mv": ma("volume", 20), "fac": div("high - low", "volume"), "roc1": "100 * (close / " + lag("close") + " - 1)", "mon": "date_trunc('month', ts)", "tp": _TP}, {"fac1": lag("fac"), "mv1": lag("mv")}],
        KEYS | {
            "obv": f"CAST(sum(coalesce(sign(close - c1), 0) * volume) {SO_FAR} AS BIGINT)", "ad": r(f"sum(coalesce({div('2 * close - high - low', 'high - low')}, 0) * volume) {SO_FAR}", 2), "pvt": r(f"sum(coalesce(roc1, 0) / 100 * volume) {SO_FAR}", 2), "nvi": r(f"100 + sum(CASE WHEN volume < v1 THEN roc1 ELSE 0 END) {SO_FAR}", 2),
            "pvi": r(f"100 + sum(CASE WHEN volume > v1 THEN roc1 ELSE 0 END) {SO_FAR}", 2), "wad": r(f"sum(CASE WHEN close > c1 THEN close - least(low, c1) WHEN close < c1 THEN close - greatest(high, c1) ELSE 0 END) {SO_FAR}", 2), "buy_volume": r(f"coalesce({div('volume * (close - low)', 'high - low')}, volume / 2)"), "volume_normal": r("100 * volume / mv"), "volume_ratio": r("volume / mv1"),
            "facilitation_state": "CASE WHEN fac > fac1 AND volume > v1 THEN 'green' WHEN NOT (fac > fac1) AND NOT (volume > v1) THEN 'fade' WHEN fac > fac1 AND NOT (volume > v1) THEN 'fake' WHEN NOT (fac > fac1) AND volume > v1 THEN 'squat' ELSE '' END", "vwap": r("sum(tp * volume) OVER (PARTITION BY ticker, mon ORDER BY ts ROWS UNBOUNDED PRECEDING) / sum(volume) OVER (PARTITION BY ticker, mon ORDER BY ts ROWS UNBOUNDED PRECEDING)"),
        },
    ),
)
def _(spark, d):
    f = framed(spark, d)
    m = ind.volume_measures(f)
    two = {"ad": ind.accumulation(f), "pvt": ind.price_volume_trend(f), "nvi": ind.volume_index(f, False), "pvi": ind.volume_index(f, True), "wad": ind.williams_ad(f)}
    return out(f, {"obv": ind.obv(f).cast("long"), **two, "buy_volume": ind.volume_split()["buy_volume"], "volume_normal": m["volume_normal"], "volume_ratio": m["volume_ratio"], "facilitation_state": ind.facilitation(f)["facilitation_state"], "vwap": ind.session_vwap(f)}, **dict.fromkeys(two, 2))


@query("f_volume_more")
def _(spark, d):
    f = framed(spark, d)
    return out(f, {"tvi": ind.trade_volume(f, 10.0), "big_rank": ind.big_volume_levels(f), "volume_osc": ind.volume_measures(f)["volume_osc"]})
