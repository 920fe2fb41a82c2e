"""Queries of order flow, rotation, targets, liquidity sheets, weekly states and strength and weakness signs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import recur as k
from tickloom.functions.frame import Frame
from tickloom.operators import crosssection, indicators as ind, timeframes, trades, vpa
from tickloom.operators.scan import scan
from tickloom.plans import walks
from tickloom.plans.bars import BARS_SQL, INTRADAY_SQL, bars_eod, bars_intraday, flows
from tickloom.plans.screens import last_bars
from tickloom.plans.series_queries import framed, out, tidy
from tickloom.plans.sqltext import KEYS, SO_FAR, SPEC, W, div, full, hhv, lag, llv, ma, r, staged

QUERIES, SQL = {}, {}

#: Least mean traded value of a liquid ticker, for the prices and volumes of the given tables.
LEAST_VALUE = 120_000.0


def query(name: str, sql: str | None = None):
    def register(make):
        QUERIES[name] = make
        if sql:
            SQL[name] = sql
        return make

    return register


def flag(x: str) -> str:
    return f"coalesce({x}, false)::BIGINT"


def wma(x: str, n: int) -> str:
    return "(" + " + ".join(f"{n - i} * {lag(x, i)}" for i in range(n)) + f") / {n * (n + 1) / 2}"


_LINES = [
    {f"m{n}": f"(({hhv('high', n)}) + ({llv('low', n)})) / 2" for n in (9, 26, 52)},
    {"sa": "lag((m26 + m9) / 2, 26) " + W, "sb": "lag(m52, 26) " + W},
    {"t": "(m9 + m26 + sa + sb) / 4"},
]


@query(
    "v_taichi",
    staged(
        _LINES,
        KEYS | {"taichi": r("t"), "taichi_ahead": r("(sa + sb) / 2"), "signal": r(wma("t", 26)), "slow_signal": r(wma("t", 52))},
    ),
)
def _(spark, d):
    f = framed(spark, d)
    return out(f, ind.taichi(f))


_FLOWS = f"""{BARS_SQL}, fl AS (SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS ts,
 coalesce(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 0) AS vb, coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0) AS vs
 FROM lineitem GROUP BY ALL), bf AS (SELECT * FROM bars LEFT JOIN fl USING (ticker, ts))"""


@query(
    "f_pressure",
    staged(
        [
            {"up": "close - low", "dn": "high - close", "sh": "1 - 1 / (1 + vb / (vs + 0.001))"},
            {"mu": ma("up", 20), "md": ma("dn", 20), "ms": ma("sh", 20), "busy": div("volume", ma("volume", 20))},
            {"rb": div("up", "mu") + " * (busy + ms)", "rs": div("dn", "md") + " * (busy + 1 - ms)"},
            {"nb": ma("rb", 5), "ns": ma("rs", 5)},
        ],
        KEYS | {"buying": r("nb"), "selling": r("ns"), "pressure": r("nb - ns")},
        source="bf",
        ctes=_FLOWS,
    ),
)
def _(spark, d):
    """Pressure of buyers and sellers, by close position, volume and the flows of each side."""
    f = Frame(bars_eod(spark, d).join(flows(spark, d).select("ticker", "ts", "buy_qty", "sell_qty"), ["ticker", "ts"], "left"))
    return out(f, ind.pressure(f, "buy_qty", "sell_qty"))


_MINUTES = "greatest(0, least(hour(ts) * 60 + minute(ts), 690) - 540) + greatest(0, least(hour(ts) * 60 + minute(ts), 900) - 780)"


@query(
    "f_transaction_speed",
    staged(
        [{"last": f"lead(1) {W} IS NULL", "passed": _MINUTES}],
        KEYS | {"speed": r("CASE WHEN last THEN volume / nullif(passed, 0) ELSE volume / 270 END")},
        source="intraday",
        ctes=INTRADAY_SQL.format(width="15 minutes"),
    ),
)
def _(spark, d):
    f = Frame(bars_intraday(spark, d, "15 minutes"))
    return out(f, {"speed": ind.transaction_speed(f, "ts")})


_PLACED = f"""{BARS_SQL}, sc AS (SELECT ticker, ts, 100 * (close / {lag('close', 20)} - 1) AS score FROM bars),
pl AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, ticker) AS place FROM sc WHERE score IS NOT NULL)"""


@query(
    "x_rotation_held",
    staged(
        [{"state": "CASE WHEN place <= 3 THEN 1 WHEN place > 5 THEN 0 END"}],
        KEYS | {"place": "place", "held": f"coalesce(last_value(state IGNORE NULLS) {SO_FAR}, 0)::BIGINT"},
        source="pl",
        ctes=_PLACED,
    ),
)
def _(spark, d):
    """Rotation with slack: in at the three best of a date, out beyond the five best."""
    f = framed(spark, d)
    return tidy(crosssection.rotation(f.add(score=f.roc("close", 20)).df, "score", 3).select("ticker", "ts", "place", "held"))


_BREAKS = [
    {"h20": hhv("high", 20), "l20": llv("low", 20), "h10": hhv("high", 10), "l10": llv("low", 10)},
    {"buy": f"coalesce(close > {lag('h20')}, false)", "short": f"coalesce(close < {lag('l20')}, false)", "st": lag("l10"), "cv": lag("h10")},
]


@query(
    "r_targets",
    staged(
        [
            *_BREAKS,
            {
                "side": f"last_value(CASE WHEN buy THEN 1 WHEN short THEN -1 END IGNORE NULLS) {SO_FAR}",
                "eb": f"last_value(CASE WHEN buy THEN row(close, st) END IGNORE NULLS) {SO_FAR}",
                "es": f"last_value(CASE WHEN short THEN row(close, cv) END IGNORE NULLS) {SO_FAR}",
            },
        ],
        KEYS
        | {f"long_{i}": flag(f"side = 1 AND high > eb[1] + {m} * (eb[1] - eb[2])") for i, m in enumerate((1, 2, 4), 1)}
        | {f"short_{i}": flag(f"side = -1 AND low < es[1] - {m} * (es[2] - es[1])") for i, m in enumerate((1, 2, 4), 1)},
    ),
)
def _(spark, d):
    """Targets at one, two and four times the first risk, of positions on the breaks of 20 bars with stops at 10."""
    f = framed(spark, d)
    h = f.hold_all({"h20": f.hhv("high", 20), "l20": f.llv("low", 20), "h10": f.hhv("high", 10), "l10": f.llv("low", 10)})
    b = f.hold_all({n: f.ref(c, -1) for n, c in h.items()})
    buy, short = f.hold(F.col("close") > b["h20"]), f.hold(F.col("close") < b["l20"])
    return out(f, trades.targets(f, buy, short, b["l10"], b["h10"]))


_BACK = "PARTITION BY ticker ORDER BY ts DESC"


@query(
    "b_backward",
    staged(
        [{"h10": hhv("high", 10), "l10": llv("low", 10)}, {"a": f"coalesce(close > {lag('h10')}, false)", "b": f"coalesce(close < {lag('l10')}, false)"},
         {"grp": f"coalesce(sum(b::INT) OVER ({_BACK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"}],
        KEYS | {
            "last_of_run": "(a AND sum(a::INT) OVER (PARTITION BY ticker, grp ORDER BY ts DESC ROWS UNBOUNDED PRECEDING) = 1)::BIGINT",
            "bars_left": f"row_number() OVER ({_BACK}) - 1",
        },
    ),
)
def _(spark, d):
    """Excess signals removed from the end: of the breaks upwards the last before one downwards."""
    f = framed(spark, d)
    hh, ll = f.hold(f.hhv("high", 10)), f.hold(f.llv("low", 10))
    a, b = f.hold(F.col("close") > f.ref(hh, -1)), f.hold(F.col("close") < f.ref(ll, -1))
    g = f.backward()
    return out(g, {"last_of_run": g.exrem(a, b), "bars_left": g.bar()})


@query(
    "b_line_between",
    staged(
        [{"left_": f"count(*) OVER ({SPEC} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 1"},
         {"p": "max(CASE WHEN left_ = 50 THEN low END) OVER (PARTITION BY ticker)", "q": "max(CASE WHEN left_ = 10 THEN close END) OVER (PARTITION BY ticker)"}],
        KEYS | {"line": r("CASE WHEN left_ <= 50 THEN p + (q - p) * (50 - left_) / 40.0 END")},
    ),
)
def _(spark, d):
    """Line from the low 50 bars before the end through the close 10 bars before it."""
    f = framed(spark, d)
    return out(f, {"line": f.line_between(("low", 50), ("close", 10))})


_LIQUID = [
    {"traded": f"({ma('volume', 20)}) * ({ma('close', 20)})", "nth": "row_number() OVER (PARTITION BY ticker ORDER BY ts DESC)"},
]
_SHEET = f"SELECT ticker, close, volume, traded FROM s1 WHERE nth = 1 AND traded > {LEAST_VALUE}"


@query(
    "e_liquidity_sheet",
    staged(_LIQUID, {"*": "*"}).split("\nSELECT")[0]
    + f", q AS ({_SHEET}), t AS (SELECT * FROM q UNION ALL SELECT 'TOTAL', avg(close), CAST(sum(volume) AS BIGINT), sum(traded) FROM q)"
    + f" SELECT ticker, {r('close', 3)} AS close, volume, {r('traded', 2)} AS traded FROM t",
)
def _(spark, d):
    """Liquid tickers on their last bar, the busiest first, with a row of totals."""
    f = framed(spark, d)
    f.add(liquid=crosssection.liquid(f, LEAST_VALUE), traded=f.ma("volume", 20) * f.ma("close", 20))
    rows = last_bars(f).where("liquid").select("ticker", "close", "volume", "traded")
    whole = crosssection.with_summary(rows, "TOTAL", close="avg", volume="sum", traded="sum")
    return crosssection.sorted_by(tidy(whole, 2, close=3), "-traded", "ticker")


_WEEKLY = f"""{walks.NUMBERED}, wk AS MATERIALIZED (SELECT *, last_value(ended IGNORE NULLS) {SO_FAR} AS weekly
 FROM (SELECT *, CASE WHEN isodow(ts) > isodow(lead(ts) {W}) THEN close END AS ended FROM b))"""
_ROC = {
    "e30": walks.ema("weekly", 30), "e65": walks.ema("weekly", 65), "sig": walks.ema("e30 - e65", 25),
}
_TURNS = [{"roc": f"sig - {lag('sig', 25)}"}, {"r5": lag("roc", 5), "r10": lag("roc", 10)}]


@query(
    "r_weekly_macd",
    staged(
        _TURNS,
        KEYS | {
            "weekly": r("weekly"), "roc": r("roc", 3), "turn_up": flag("roc > r5 AND r5 <= r10"), "turn_down": flag("roc < r5 AND r5 >= r10"),
            "steady_up": flag("roc > r5 AND r5 >= r10"), "steady_down": flag("roc < r5 AND r5 <= r10"), "flat": flag("roc = r5"),
        },
        source="w",
        ctes=walks.walk(_ROC, ctes=_WEEKLY, source="wk"),
        recursive=True,
    ),
)
def _(spark, d):
    """Change of a MACD on week-end closes, and its states; a week's last bar is known by the next one (looks ahead by a bar)."""
    f = framed(spark, d)
    f.add(weekly=timeframes.week_end_value(f, "close"))
    f = Frame(scan(f.df.select("ticker", "ts", "open", "high", "low", "close", "volume", "weekly"), {"sig": k.weekly_macd_signal}))
    roc = f.hold(f.momentum("sig", 25))
    b = f.hold_all({"r5": f.ref(roc, -5), "r10": f.ref(roc, -10)})
    up, down, rose = roc > b["r5"], roc < b["r5"], b["r5"] >= b["r10"]
    states = {
        "turn_up": up & (b["r5"] <= b["r10"]), "turn_down": down & rose, "steady_up": up & rose,
        "steady_down": down & (b["r5"] <= b["r10"]), "flat": roc == b["r5"],
    }
    return out(f, {"weekly": F.col("weekly"), "roc": roc} | {n: F.coalesce(c, F.lit(False)) for n, c in states.items()}, roc=3)


@query(
    "i_macd_trend",
    staged(
        [],
        KEYS | {"up": flag("macd > 0 AND macd > signal"), "down": flag("macd < 0 AND macd < signal")},
        source="w",
        ctes=walks.walk(walks.MACD),
        recursive=True,
    ),
)
def _(spark, d):
    f = Frame(scan(bars_eod(spark, d), {"macd": lambda b: k.macd(b.c), "signal": lambda b: k.macd_signal(b.c)}))
    return out(f, {"up": F.expr("macd > 0 and macd > signal"), "down": F.expr("macd < 0 and macd < signal")})


_CLOUD = f"{walks.NUMBERED}, cl AS MATERIALIZED (SELECT *, " + ", ".join(f"(({hhv('high', n)}) + ({llv('low', n)})) / 2 AS m{n}" for n in (3, 5, 20)) + " FROM b)"


@query(
    "v_sun_and_cloud",
    staged(
        [{"kk": "(high + 2 * close + low) / 4"}],
        KEYS | {
            "sun": r("sun"), "cloud": r("cloud"), "edge": r("CASE WHEN sun > cloud THEN cloud WHEN sun <= cloud THEN sun END"),
            "spread": r("CASE WHEN kk >= m3 * 1.05 THEN 1.1 * m3 WHEN kk >= m3 THEN m3 WHEN m3 IS NOT NULL THEN 0.9 * m3 END"),
        },
        source="w",
        ctes=walks.walk({"cloud": walks.ema("m20", 20), "sun": walks.ema("m5", 10)}, ctes=_CLOUD, source="cl"),
        recursive=True,
    ),
)
def _(spark, d):
    """Smoothed middles of 5 and 20 bars, the edge between them, and a step line of the 3-bar middle."""
    f = Frame(scan(bars_eod(spark, d), {"sun": lambda b: k.ema(k.middle(b, 5), 10), "cloud": lambda b: k.ema(k.middle(b, 20), 20)}))
    m, kk = f.hold((f.hhv("high", 3) + f.llv("low", 3)) / 2), F.expr("(high + 2 * close + low) / 4")
    step = F.when(kk >= m * 1.05, 1.1 * m).when(kk >= m, m).when(m.isNotNull(), 0.9 * m)
    edge = F.when(F.col("cloud").isNotNull(), F.least("sun", "cloud"))
    return out(f, {"sun": F.col("sun"), "cloud": F.col("cloud"), "edge": edge, "spread": step})


_HA = f"{walks.NUMBERED}, hb AS MATERIALIZED (SELECT *, (open + high + low + close) / 4 AS hc FROM b), hx AS MATERIALIZED (SELECT *, coalesce(lag(hc) {W}, open) AS hp FROM hb)"


@query(
    "r_ray_stop",
    staged(
        [{"hh": "greatest(high, ho, hc)"}, {"base": llv("hh", 3) + " - atr4"}, {"ray": hhv("base", 5)}],
        KEYS | {"ray": r("ray"), "above": flag(f"hc > ray AND {lag('hc')} <= {lag('ray')}"), "below": flag(f"ray > hc AND {lag('ray')} <= {lag('hc')}")},
        source="w",
        ctes=walks.walk({"ho": ("hp", "0.5"), "atr4": walks.wilders("tr", 4)}, ctes=_HA, source="hx"),
        recursive=True,
    ),
)
def _(spark, d):
    """Highest of five ray values: the 3-bar low of the smoothed candles' highs less the average range of 4 bars."""
    steps = {"ha_high": lambda b: k.heikin_ashi(b)[1], "ha_close": lambda b: k.heikin_ashi(b)[3], "atr4": lambda b: k.atr(b, 4)}
    f = Frame(scan(bars_eod(spark, d), steps))
    base = f.hold(f.llv("ha_high", 3) - F.col("atr4"))
    ray = f.hold(f.hhv(base, 5))
    return out(f, {"ray": ray, "above": f.cross("ha_close", ray), "below": f.cross(ray, "ha_close")})


_DATES = f"""{BARS_SQL}, ch AS (SELECT ts, close - lag(close) {W} AS x FROM bars),
sh AS MATERIALIZED (SELECT 'INDEX' AS ticker, ts, row_number() OVER (ORDER BY ts) AS i, 100.0 * count_if(x > 0) / nullif(count_if(x > 0) + count_if(x < 0), 0) AS share FROM ch GROUP BY ts)"""


@query("x_stix", f"WITH RECURSIVE {walks.walk({'stix': walks.ema('share', 21)}, ctes=_DATES, source='sh')} SELECT ts, {r('stix')} AS stix FROM w")
def _(spark, d):
    """Smoothed share of advancing issues: one row a date, smoothed in one pass over the calendar."""
    share = crosssection.stix(crosssection.breadth(bars_eod(spark, d)))
    bars = share.withColumns({c: F.col("close") for c in ("open", "high", "low")} | {"volume": F.lit(0)})
    return tidy(scan(bars, {"stix": lambda b: k.ema(b.c, 21)}).select("ts", "stix"))


_V = {
    "av": ma("volume", 30), "v3": hhv("volume", 3), "v5": hhv("volume", 5), "rg": "high - low",
    **{f"h{n}": hhv("high", n) for n in (5, 20, 100)}, **{f"l{n}": llv("low", n) for n in (5, 20, 100)},
}
_LAGS = {f"{x}b": lag(x) for x in ("v3", "v5", "h5", "h20", "h100", "l5", "l20", "l100", "close", "high", "low", "volume", "rg")}
_TERMS = {
    "uhv": "volume > 2 * av", "hv": "volume > 1.1 * av AND volume < 2 * av", "uw": "rg > 2 * ar", "wr": "rg > 1.33 * ar AND rg < 2 * ar",
    "nr": "rg > 0.67 * ar AND rg < 1.33 * ar", "sr": "rg < 0.67 * ar", "us": "rg < 0.5 * ar", "u3": "close > high - rg / 3",
    "m3": "close < high - rg / 3 AND close > low + rg / 3", "d3": "close < low + rg / 3", "dn": "close < closeb", "up": "close > closeb",
    "quiet": f"((rg < rgb AND rg < {lag('rg', 2)}) OR rg < 0.67 * ar OR rg < 0.5 * ar) AND volume < volumeb AND volume < {lag('volume', 2)}",
    "nx": f"lead(close) {W}",
}
_SIGNS = {
    "sos1": "dn AND ((volume > v3b AND low < l20b) OR uhv) AND (uw OR wr) AND (m3 OR u3)",
    "sos2": "dn AND ((hv AND low < l20b) OR uhv) AND (uw OR wr) AND (m3 OR u3)",
    "sos3": "dn AND (m3 OR u3) AND (nr OR sr) AND (low < l20b OR uhv)",
    "sos4": "dn AND uhv AND high < lowb AND (nr OR sr OR us) AND low < l100b",
    "sos5": "(uw OR wr OR rg > ar) AND u3 AND low < l5b",
    "sos6": "dn AND quiet",
    "sos7": "dn AND d3 AND (uhv OR ((hv OR volume > v5b) AND low < l5b)) AND nx > close",
    "sos8": "low < lowb AND close > highb AND (hv OR uhv OR volume > v5b)",
    "sow1": "up AND ((volume > v3b AND high > h20b) OR uhv) AND (uw OR wr) AND (m3 OR d3)",
    "sow2": "up AND ((hv AND high > h20b) OR uhv) AND (uw OR wr) AND (d3 OR m3)",
    "sow3": "up AND (m3 OR d3) AND (nr OR sr) AND (high > h20b OR uhv)",
    "sow4": "up AND uhv AND (nr OR sr OR us) AND high > h100b",
    "sow5": "(uw OR wr OR rg > ar) AND d3 AND high > h5b",
    "sow6": "up AND quiet",
    "sow7": "up AND u3 AND (uhv OR ((hv OR volume > v5b) AND high > h5b)) AND nx < close",
    "sow8": "high > highb AND close < lowb AND (hv OR uhv OR volume > v5b)",
}


@query(
    "q_strength_weakness",
    staged(
        [_V, _LAGS, _TERMS], KEYS | {n: flag(s) for n, s in _SIGNS.items()},
        source="w", ctes=walks.walk({"ar": walks.ema("high - low", 30)}), recursive=True,
    ),
)
def _(spark, d):
    f = Frame(scan(bars_eod(spark, d), {"mean_range": lambda b: k.ema(b.h - b.l, 30)}))
    return out(f, vpa.strength_and_weakness(f, "mean_range"))


_MONTHS = f"""{walks.NUMBERED}, m AS (SELECT ticker, date_trunc('month', ts) AS ts, arg_max(close, ts) AS close, max(high) AS high, min(low) AS low
 FROM bars GROUP BY ticker, date_trunc('month', ts)), mb AS (SELECT *, row_number() {W} AS i, lag(close) {W} AS c1 FROM m),
mn AS MATERIALIZED (SELECT *, greatest(high, coalesce(c1, high)) - least(low, coalesce(c1, low)) AS tr FROM mb)"""
_LEVELS = f"""{walks.walk({"monthly": walks.wilders("tr", 2)}, ctes=_MONTHS, source="mn", into="mw")},
mp AS (SELECT ticker, ts AS p, lag(close) {W} AS mid, lag(monthly) {W} AS a FROM mw),
lv AS MATERIALIZED (SELECT b.*, mid, mid - 0.75 * a AS low_level, mid + 0.75 * a AS top_level
 FROM b JOIN mp ON b.ticker = mp.ticker AND date_trunc('month', b.ts) = p)"""


@query(
    "v_monthly_levels",
    staged(
        [],
        KEYS | {
            "middle": r("y"), "support": r("s1"), "resistance": r("r1"), "buy": flag(f"close > s1 AND {lag('close')} <= {lag('s1')}"),
            "sell": flag(f"r1 > close AND {lag('r1')} <= {lag('close')}"),
        },
        source="w",
        ctes=walks.walk({"y": walks.ema("mid", 2), "s1": walks.ema("low_level", 2), "r1": walks.ema("top_level", 2)}, ctes=_LEVELS, source="lv"),
        recursive=True,
    ),
)
def _(spark, d):
    """Last completed month's close with levels 0.75 of its average range away, smoothed, and the bars that cross them."""

    def level(times):
        return lambda b: k.ema(timeframes.on_periods(b, "M", lambda p: p.c + times * k.atr(p, 2)), 2)

    steps = {"middle": level(0), "support": level(-0.75), "resistance": level(0.75)}
    f = Frame(scan(bars_eod(spark, d), steps))
    lines = {n: F.col(n) for n in steps}
    return out(f, lines | {"buy": f.cross("close", "support"), "sell": f.cross("resistance", "close")})
