"""Queries of swings, levels, lines, channels and cycle averages, with SQL written from the formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import recur as k
from tickloom.functions import swings as sw
from tickloom.operators import swings
from tickloom.operators.scan import scan
from tickloom.plans import walks
from tickloom.plans.bars import bars_eod
from tickloom.plans.series_queries import out, tidy
from tickloom.plans.sqltext import SO_FAR, SPEC, W, hhv, lag, llv, r

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(make):
        QUERIES[name] = make
        if sql:
            SQL[name] = sql
        return make

    return register


def zigzag(source: str, high: str, low: str, pct: float, into: str = "z", first: str = "i = 1") -> str:
    """Table ``into`` (ticker, i, e_side, e_i, e_p): the swing that a bar confirms, side 0 if none; one step a bar for all tickers."""
    fall, rise = f"{round(1 - pct / 100, 6)}", f"{round(1 + pct / 100, 6)}"
    return f"""{into} AS (
 SELECT ticker, i, 0 AS side, i AS t_i, CAST({high} AS DOUBLE) AS t_p, i AS b_i, CAST({low} AS DOUBLE) AS b_p,
  0 AS e_side, CAST(NULL AS BIGINT) AS e_i, CAST(NULL AS DOUBLE) AS e_p FROM {source} WHERE {first}
 UNION ALL SELECT ticker, i, CASE WHEN dn THEN -1 WHEN up THEN 1 ELSE side END, CASE WHEN up THEN i ELSE t_i END, CASE WHEN up THEN h ELSE t_p END,
  CASE WHEN dn THEN i ELSE b_i END, CASE WHEN dn THEN l ELSE b_p END,
  CASE WHEN dn THEN 1 WHEN up THEN -1 ELSE 0 END, CASE WHEN dn THEN t_i WHEN up THEN b_i END, CASE WHEN dn THEN t_p WHEN up THEN b_p END
 FROM (SELECT *, NOT dn AND coalesce(side <= 0 AND h >= b_p * {rise} AND b_i < i, false) AS up
  FROM (SELECT *, coalesce(side >= 0 AND l <= t_p * {fall} AND t_i < i, false) AS dn
   FROM (SELECT n.ticker, n.i, n.h, n.l, side,
     CASE WHEN side >= 0 AND n.h > t_p THEN n.i ELSE t_i END AS t_i, CASE WHEN side >= 0 AND n.h > t_p THEN n.h ELSE t_p END AS t_p,
     CASE WHEN side <= 0 AND n.l < b_p THEN n.i ELSE b_i END AS b_i, CASE WHEN side <= 0 AND n.l < b_p THEN n.l ELSE b_p END AS b_p
    FROM {into} p JOIN (SELECT ticker, i, {high} AS h, {low} AS l FROM {source}) n ON n.ticker = p.ticker AND n.i = p.i + 1))))"""


def last_of(x: str, order: str = SO_FAR) -> str:
    return f"last_value({x} IGNORE NULLS) {order}"


def first_only(a: str, b: str, source: str, into: str) -> str:
    """``source`` with first_a and first_b: each signal only until the other came."""
    before = f"OVER ({SPEC} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{into}_g AS (SELECT *, coalesce(sum({b}::INT) {before}, 0) AS g_a, coalesce(sum({a}::INT) {before}, 0) AS g_b FROM {source}),
{into} AS (SELECT *, ({a} AND sum({a}::INT) OVER (PARTITION BY ticker, g_a ORDER BY ts ROWS UNBOUNDED PRECEDING) = 1)::BIGINT AS first_a,
 ({b} AND sum({b}::INT) OVER (PARTITION BY ticker, g_b ORDER BY ts ROWS UNBOUNDED PRECEDING) = 1)::BIGINT AS first_b FROM {into}_g)"""


def crossing(a: str, b: str) -> str:
    return f"coalesce({a} > {b} AND {lag(a)} <= {lag(b)}, false)"


def ordered(cte: str) -> str:
    """``cte`` as one table expression of a recursive WITH."""
    return f"WITH RECURSIVE {cte}"


# -- swings by their confirming bars --------------------------------------------------
_TEN = f"{walks.NUMBERED}, {zigzag('b', 'close', 'close', 10)}"


@query(
    "b_true_swings",
    ordered(f"{walks.NUMBERED}, {zigzag('b', 'high', 'low', 10)}")
    + f" SELECT b.ticker, b.ts, {r(last_of('CASE WHEN e_side = 1 THEN e_p END'))} AS last_peak, {r(last_of('CASE WHEN e_side = -1 THEN e_p END'))} AS last_trough FROM b JOIN z USING (ticker, i)",
)
def _(spark, d):
    """Swings of highs and lows, rather than closes: last peak and trough on each bar, known from their confirming bars."""
    f = swings.marked(bars_eod(spark, d), 10, "h", "l")
    return out(f, {"last_peak": swings.last_two(f, 1)[0]["price"], "last_trough": swings.last_two(f, -1)[0]["price"]})


_BREAKS = f"""{walks.NUMBERED}, {zigzag('b', 'close', 'close', 1)},
m1 AS (SELECT b.ticker, b.ts, b.close, {last_of('CASE WHEN e_side = 1 THEN e_p END')} AS pk, {last_of('CASE WHEN e_side = -1 THEN e_p END')} AS tr FROM b JOIN z USING (ticker, i)),
m2 AS (SELECT *, {lag('pk')} AS upper_, {lag('tr')} AS lower_ FROM m1),
m3 AS (SELECT *, {crossing('close', 'upper_')} AS up, {crossing('lower_', 'close')} AS dn FROM m2), {first_only('up', 'dn', 'm3', 'm4')}"""


@query("c_peak_breaks", ordered(_BREAKS) + f" SELECT ticker, ts, {r('upper_')} AS upper, {r('lower_')} AS lower, first_a AS buy, first_b AS sell FROM m4")
def _(spark, d):
    f = swings.marked(bars_eod(spark, d), 1)
    return out(f, swings.peak_breaks(f))


def _lines_sql(pct: float) -> str:
    side = lambda s, name: f"""{name} AS (SELECT ticker, i, e_i, e_p, lag(e_i) OVER p AS p_i, lag(e_p) OVER p AS p_p FROM z WHERE e_side = {s} WINDOW p AS (PARTITION BY ticker ORDER BY i))"""
    line = lambda t, rule: f"CASE WHEN {t}.p_p {rule} {t}.e_p THEN {t}.e_p + ({t}.p_p - {t}.e_p) / ({t}.p_i - {t}.e_i) * (b.i - {t}.e_i) END"
    return (
        ordered(f"{walks.NUMBERED}, {zigzag('b', 'high', 'low', pct)}, {side(1, 'tops')}, {side(-1, 'lows')},")
        + f"""
j AS (SELECT b.ticker, b.ts, b.close, {line('lows', '<')} AS line_low, {line('tops', '>')} AS line_top
 FROM b ASOF LEFT JOIN lows ON b.ticker = lows.ticker AND b.i >= lows.i ASOF LEFT JOIN tops ON b.ticker = tops.ticker AND b.i >= tops.i)
SELECT ticker, ts, {r('line_low')} AS line_low, {r('line_top')} AS line_top, {crossing('line_low', 'close')}::BIGINT AS break_low, {crossing('close', 'line_top')}::BIGINT AS break_top FROM j"""
    )


for _name, _pct in (("c_trend_breaks", 10.0), ("c_trend_breaks_wide", 40.0)):

    @query(_name, _lines_sql(_pct))
    def _(spark, d, pct=_pct):
        """Lines through the last two confirmed lows (rising) and highs (falling), and closes that break them."""
        f = swings.marked(bars_eod(spark, d), pct, "h", "l")
        return out(f, swings.trend_lines(f))


_CHANNEL = f"""{walks.walk(walks.RSI, ctes=walks.RICH, source='c')}, {zigzag('w', 'rsi', 'rsi', 35, first='i = 15')},
ev AS (SELECT ticker, i, e_i, lag(e_i) OVER (PARTITION BY ticker ORDER BY i) AS p_i FROM z WHERE e_side <> 0),
seg AS (SELECT ev.ticker, ev.i AS known, ev.p_i, regr_slope(w.rsi, w.i) AS b1, regr_intercept(w.rsi, w.i) AS b0,
  CASE WHEN count(*) > 2 THEN sqrt(greatest(0, regr_syy(w.rsi, w.i) - regr_slope(w.rsi, w.i) * regr_sxy(w.rsi, w.i)) / (count(*) - 2)) END AS e
 FROM ev JOIN w ON w.ticker = ev.ticker AND w.i BETWEEN ev.p_i AND ev.e_i WHERE ev.p_i IS NOT NULL GROUP BY ALL),
j AS (SELECT w.ticker, w.ts, w.rsi, b0 + b1 * w.i + 2 * e AS top_, b0 + b1 * w.i - 2 * e AS low_ FROM w ASOF LEFT JOIN seg ON w.ticker = seg.ticker AND w.i >= seg.known),
m3 AS (SELECT *, {crossing('rsi', 'top_')} AS up, {crossing('low_', 'rsi')} AS dn FROM j), {first_only('up', 'dn', 'm3', 'm4')}"""


@query("i_rsi_channel", ordered(_CHANNEL) + f" SELECT ticker, ts, {r('rsi', 3)} AS rsi, {r('top_', 3)} AS channel_top, {r('low_', 3)} AS channel_low, up::BIGINT AS buy_channel, dn::BIGINT AS sell_channel, first_a AS buy, first_b AS sell FROM m4")
def _(spark, d):
    f = swings.rsi_channel(bars_eod(spark, d))
    return tidy(f.df.select("ticker", "ts", "rsi", "channel_top", "channel_low", "buy_channel", "sell_channel", "buy", "sell"), 3)


# -- major levels and the pivot box ---------------------------------------------------
_HEIKIN = f"{walks.NUMBERED}, c AS MATERIALIZED (SELECT *, (open + high + low + close) / 4 AS hc, CASE WHEN i = 1 THEN open ELSE lag((open + high + low + close) / 4) {W} END AS hb FROM b)"
_TEMA = {"ho": ("hb", "0.5")} | {n: walks.ema(x, 2) for x, names in (("high", ("h1", "h2", "h3")), ("low", ("l1", "l2", "l3"))) for n, x in zip(names, (x, *names))}


def _turns(side: int, test: str, ha: str, price: str) -> str:
    rule = "test > lag(test) {w} AND lead(test) {w} < " if side > 0 else "test < lag(test) {w} AND lead(test) {w} > "
    return f"SELECT ticker, {side} AS side, ts, i, {ha} AS price FROM (SELECT *, {rule.format(w=W)}{price} AS turn FROM (SELECT *, {test} AS test FROM w)) WHERE turn"


_LEVELS = f"""{walks.walk(_TEMA, ctes=_HEIKIN, source='c')},
t AS ({_turns(1, '3 * h1 - 3 * h2 + h3', 'greatest(high, ho, hc)', 'high')} UNION ALL {_turns(-1, '3 * l1 - 3 * l2 + l3', 'least(low, ho, hc)', 'low')}),
n AS (SELECT *, lag(price) OVER s AS before, lead(price) OVER s AS after, lead(i) OVER s AS next_i FROM t WINDOW s AS (PARTITION BY ticker, side ORDER BY i)),
m AS (SELECT * FROM n WHERE side * (price - before) > 0 AND side * (price - after) > 0)"""


@query(
    "b_major_levels",
    ordered(_LEVELS)
    + f""" SELECT ticker, side, ts, i - 1 AS bar, {r('price')} AS price, next_i AS from_bar, lead(next_i, 6) OVER s AS until_bar,
 CASE WHEN row_number() OVER (PARTITION BY ticker, side ORDER BY i DESC) <= 6 THEN row_number() OVER (PARTITION BY ticker, side ORDER BY i DESC) END AS nth FROM m WINDOW s AS (PARTITION BY ticker, side ORDER BY i)""",
)
def _(spark, d):
    """Levels at major peaks and valleys, with the bars between which each is among the last six of its side."""
    return tidy(swings.major_levels(bars_eod(spark, d)))


_BOX = f"""{walks.walk({'ho': ('hb', '0.5')}, ctes=_HEIKIN, source='c')},
q AS MATERIALIZED (SELECT *, coalesce({lag('high', 2)} = {hhv('high', 7)}, false) AS s1, coalesce({lag('low', 2)} = {llv('low', 7)}, false) AS s2 FROM w),
x AS (SELECT ticker, i, CAST(-9 AS BIGINT) AS a1, CAST(-9 AS BIGINT) AS a2 FROM q WHERE i = 1
 UNION ALL SELECT q.ticker, q.i, CASE WHEN s1 AND q.i - a1 > 3 THEN q.i ELSE a1 END, CASE WHEN s2 AND q.i - a2 > 3 THEN q.i ELSE a2 END FROM x JOIN q ON q.ticker = x.ticker AND q.i = x.i + 1)
SELECT q.ticker, q.ts, {r('greatest(t.high, t.ho, t.hc)')} AS box_top, {r('least(l.low, l.ho, l.hc)')} AS box_low
FROM q JOIN x USING (ticker, i) LEFT JOIN q t ON t.ticker = q.ticker AND t.i = x.a1 LEFT JOIN q l ON l.ticker = q.ticker AND l.i = x.a2"""


def _box_of(b: k.Bars):
    return sw.pivot_box(b)


@query("b_pivot_box", ordered(_BOX))
def _(spark, d):
    made = scan(bars_eod(spark, d), {"box_top": lambda b: b.once(_box_of)[0], "box_low": lambda b: b.once(_box_of)[1]})
    return tidy(made.select("ticker", "ts", "box_top", "box_low"))


# -- harmonic patterns on the reversals of a trailing stop -----------------------------
def _fits(side: int) -> str:
    """Patterns whose ratios X, A, B and C fit, in their order."""
    ab, bc = f"({side} * (a - b)) / nullif({side} * (a - x), 0)", f"({side} * (c - b)) / nullif({side} * (a - b), 0)"
    return "list_filter([" + ", ".join(f"CASE WHEN {ab} > {rb[0]} AND {ab} < {rb[1]} AND {bc} > {rc[0]} AND {bc} < {rc[1]} THEN '{name}' END" for name, (rb, rc, _, _) in swings.TRAIL_HARMONICS.items()) + "], lambda v: v IS NOT NULL)"


def _reached(side: int) -> str:
    """The first pattern that the price ``d`` completes."""
    cases = []
    for name, (_, _, (near, far), passed) in swings.TRAIL_HARMONICS.items():
        depth, gone = f"{side} * (a - x)", f"{side} * (a - d)"
        cases.append(f"WHEN list_contains(fits, '{name}') AND {gone} > {depth} * {near} AND {gone} < {depth} * {far} AND {side} * (d - {passed}) < 0 THEN '{name}'")
    return f"CASE {' '.join(cases)} END"


def _hits(side: int) -> str:
    price, worst, best = ("low", "min(o.low)", "max(o.high)") if side > 0 else ("high", "max(o.high)", "min(o.low)")
    return f"""SELECT ticker, ts, {side} AS side, {_reached(side)} AS pattern, x, a, b, c, d FROM (
 SELECT g.ticker, g.ts, g.{price} AS d, e.x, e.a, e.b, e.c, e.fits, {worst} AS worst, {best} AS best
 FROM g ASOF JOIN (SELECT * FROM (SELECT *, {_fits(side)} AS fits FROM legs WHERE side = {side}) WHERE len(fits) > 0) e ON g.ticker = e.ticker AND g.i >= e.known
 JOIN g o ON o.ticker = g.ticker AND o.i BETWEEN e.bar AND g.i
 WHERE g.side = {-side} AND g.fresh GROUP BY g.ticker, g.ts, g.{price}, e.x, e.a, e.b, e.c, e.fits) WHERE worst = d AND {side} * (best - c) <= 0"""


_STOPPED = f"""{walks.walk({'atr': walks.wilders('tr', 20)})},
st AS (SELECT ticker, i, CAST(0 AS DOUBLE) AS stop FROM w WHERE i = 1
 UNION ALL SELECT w.ticker, w.i, CASE WHEN w.close > stop AND w.c1 > stop THEN greatest(stop, w.close - 2 * w.atr) WHEN w.close < stop AND w.c1 < stop THEN least(stop, w.close + 2 * w.atr)
  WHEN w.close > stop THEN w.close - 2 * w.atr ELSE w.close + 2 * w.atr END FROM st JOIN w ON w.ticker = st.ticker AND w.i = st.i + 1),
g1 AS (SELECT w.*, CAST({last_of('CASE WHEN w.i > 1 THEN nullif(sign(close - stop), 0) END')} AS BIGINT) AS side FROM w JOIN st USING (ticker, i)),
g2 AS (SELECT *, coalesce({lag('side')}, 0) AS side1 FROM g1 WHERE side IS NOT NULL),
g3 AS (SELECT *, sum((side <> side1)::INT) {SO_FAR} AS leg FROM g2),
g AS MATERIALIZED (SELECT *, CASE WHEN side > 0 THEN high = max(high) OVER l ELSE low = min(low) OVER l END AS fresh FROM g3 WINDOW l AS (PARTITION BY ticker, leg ORDER BY ts ROWS UNBOUNDED PRECEDING)),
one AS (SELECT ticker, leg, any_value(side) AS side, max(i) + 1 AS known, CASE WHEN any_value(side) > 0 THEN max(high) ELSE min(low) END AS c, max(i) FILTER (fresh) AS bar FROM g GROUP BY ticker, leg),
legs AS MATERIALIZED (SELECT *, lag(c) OVER s AS b, lag(c, 2) OVER s AS a, lag(c, 3) OVER s AS x FROM one WINDOW s AS (PARTITION BY ticker ORDER BY leg))"""


@query("c_harmonics_on_stops", ordered(_STOPPED) + f" SELECT ticker, ts, side, pattern, {', '.join(f'{r(p)} AS {p}' for p in 'xabcd')} FROM ({_hits(1)} UNION ALL {_hits(-1)}) WHERE pattern IS NOT NULL")
def _(spark, d):
    """Harmonic patterns on the extremes between reversals of a trailing stop, on the bars that reach D."""
    return tidy(swings.trail_harmonics(bars_eod(spark, d)))


# -- averages that follow the cycle ---------------------------------------------------
_MIDDLE = f"{walks.NUMBERED}, c AS MATERIALIZED (SELECT *, (high + low) / 2 AS p FROM b)"
_SMOOTH = f"CASE WHEN i > 6 THEN (4 * p + 3 * {lag('p')} + 2 * {lag('p', 2)} + {lag('p', 3)}) / 10 ELSE 0 END"


def _quadrature(x: str) -> str:
    return f"CASE WHEN i > 6 THEN 0.54 * (0.0962 * {x} + 0.5769 * {lag(x, 2)} - 0.5769 * {lag(x, 4)} - 0.0962 * {lag(x, 6)}) ELSE 0 END"


_PHASE = f"""{_MIDDLE}, s1 AS (SELECT *, {_SMOOTH} AS sm FROM c), s2 AS (SELECT *, {_quadrature('sm')} AS de FROM s1),
s3 AS MATERIALIZED (SELECT *, {_quadrature('de')} AS q, coalesce({lag('de', 3)}, 0) AS i1 FROM s2),
e AS (SELECT ticker, i, CAST(0 AS DOUBLE) AS phase, CAST(0 AS DOUBLE) AS mama, CAST(0 AS DOUBLE) AS fama FROM s3 WHERE i = 1
 UNION ALL SELECT ticker, i, phase, alpha * p + (1 - alpha) * mama, 0.2 * alpha * p + (1 - 0.2 * alpha) * fama
 FROM (SELECT *, CASE WHEN i > 6 THEN greatest(0.05, 0.5 / greatest(1.0, was - phase)) ELSE 0 END AS alpha
  FROM (SELECT s3.ticker, s3.i, s3.p, CASE WHEN s3.i <= 6 OR i1 = 0 THEN 0 WHEN q = 0 THEN e.phase ELSE 2 * pi() / atan(q / i1) END AS phase, e.phase AS was, mama, fama FROM e JOIN s3 ON s3.ticker = e.ticker AND s3.i = e.i + 1)))"""


def _phase_of(b: k.Bars):
    return sw.phase_average(b)


@query("a_phase_average", ordered(_PHASE) + f" SELECT s3.ticker, s3.ts, {r('mama', 3)} AS mama, {r('fama', 3)} AS fama FROM s3 JOIN e USING (ticker, i)")
def _(spark, d):
    """The phase-adaptive average and its follower."""
    made = scan(bars_eod(spark, d), {"mama": lambda b: b.once(_phase_of)[0], "fama": lambda b: b.once(_phase_of)[1]})
    return tidy(made.select("ticker", "ts", "mama", "fama"), 3)


def _filtered(x: str) -> str:
    return f"(0.0962 * {x}[1] + 0.5769 * {x}[3] - 0.5769 * {x}[5] - 0.0962 * {x}[7])"


_ZEROS = "list_value(" + ", ".join(["CAST(0 AS DOUBLE)"] * 7) + ")"
_push = lambda new, x: f"list_prepend(CAST({new} AS DOUBLE), {x}[1:6])"
_CYCLE = f"""{_MIDDLE}, s1 AS MATERIALIZED (SELECT *, {_SMOOTH} AS sm FROM c),
e AS (SELECT ticker, i, {_ZEROS} AS sm, {_ZEROS} AS de, {_ZEROS} AS q1, {_ZEROS} AS i1, {', '.join(f'CAST(0 AS DOUBLE) AS {n}' for n in ('i3', 'q3', 're', 'im', 'raw', 'period', 'sp'))}, close AS fast, close AS slow FROM s1 WHERE i = 1
 UNION ALL SELECT ticker, i, sm, de, q1, i1, i3, q3, re, im, raw, period, sp,
  fast + (close - fast) * least(1.0, 2 / (floor(sp + 0.5) + 1)), slow + (close - slow) * least(1.0, 2 / (2 * floor(sp + 0.5) + 1))
 FROM (SELECT * EXCLUDE (sp), CASE WHEN i > 6 THEN 0.33 * period + 0.67 * sp ELSE 0 END AS sp
 FROM (SELECT * EXCLUDE (period), CASE WHEN i > 6 THEN 0.2 * least(50.0, greatest(6.0, CASE WHEN raw > 1.5 * was THEN 1.5 * was WHEN raw < 0.67 * was THEN 0.67 * was ELSE raw END)) + 0.8 * period ELSE 0 END AS period
 FROM (SELECT * EXCLUDE (raw), CASE WHEN im <> 0 AND re <> 0 THEN 2 * pi() / atan(im / re) ELSE raw END AS raw, raw AS was
 FROM (SELECT * EXCLUDE (re, im, i3b, q3b), CASE WHEN i > 6 THEN 0.2 * (i3 * i3b + q3 * q3b) + 0.8 * re ELSE 0 END AS re, CASE WHEN i > 6 THEN 0.2 * (i3 * q3b - q3 * i3b) + 0.8 * im ELSE 0 END AS im
 FROM (SELECT * EXCLUDE (i3, q3), i3 AS i3b, q3 AS q3b, CASE WHEN i > 6 THEN 0.2 * (i1[1] - {_filtered('q1')} * gain) + 0.8 * i3 ELSE 0 END AS i3, CASE WHEN i > 6 THEN 0.2 * (q1[1] + {_filtered('i1')} * gain) + 0.8 * q3 ELSE 0 END AS q3
 FROM (SELECT * EXCLUDE (q1, i1), CASE WHEN i > 6 THEN {_push(f"{_filtered('de')} * gain", 'q1')} ELSE q1 END AS q1, CASE WHEN i > 6 THEN {_push('de[4]', 'i1')} ELSE i1 END AS i1
 FROM (SELECT * EXCLUDE (de), CASE WHEN i > 6 THEN {_push(f"{_filtered('sm')} * gain", 'de')} ELSE de END AS de
 FROM (SELECT s1.ticker, s1.i, s1.close, {_push('s1.sm', 'e.sm')} AS sm, de, q1, i1, i3, q3, re, im, raw, period, sp, fast, slow, 0.075 * period + 0.54 AS gain FROM e JOIN s1 ON s1.ticker = e.ticker AND s1.i = e.i + 1)))))))))
SELECT s1.ticker, s1.ts, {r('fast - slow', 2)} AS macd, {r('CASE WHEN s1.i >= 9 THEN avg(fast - slow) OVER (PARTITION BY s1.ticker ORDER BY s1.ts ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) END', 2)} AS signal, {r('sp', 2)} AS cycle FROM s1 JOIN e USING (ticker, i)"""


def _cycle_of(b: k.Bars):
    return sw.cycle_macd(b)


@query("i_cycle_macd", ordered(_CYCLE))
def _(spark, d):
    """MACD over one and two dominant cycles, and the cycle."""
    made = scan(bars_eod(spark, d), {"macd": lambda b: b.once(_cycle_of)[0], "signal": lambda b: b.once(_cycle_of)[1], "cycle": lambda b: b.once(sw.cycle_of)["smooth_period"]})
    return tidy(made.select("ticker", "ts", "macd", "signal", "cycle"), 2)
