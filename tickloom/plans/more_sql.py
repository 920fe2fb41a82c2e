"""DuckDB SQL for queries whose text would crowd their module."""

from __future__ import annotations

from tickloom.plans.bars import BARS_SQL
from tickloom.plans.screens import _PIVOT_ROWS
from tickloom.plans.sqltext import KEYS, SO_FAR, SPEC, W, full, hhv, lag, llv, ma, over, r, staged, total
from tickloom.plans import walks

_P = "PARTITION BY ticker ORDER BY bar"
_WOLFE = ", ".join(f"lag({c}, {k}) OVER ({_P}) AS {c[0]}{5 - k}" for k in range(1, 5) for c in ("price", "bar"))
_SIX = ", ".join(f"lag(price, {k}) OVER ({_P}) AS p{5 - k}" for k in range(1, 6))
_FIVE = ", ".join(f"lag(price, {k}) OVER ({_P}) AS {n}" for k, n in ((4, "x"), (3, "a"), (2, "b"), (1, "c")))


def _wma(x: str, n: int) -> str:
    return "(" + " + ".join(f"{n - k} * lag({x}, {k}) OVER (ORDER BY ts)" for k in range(n)) + f") / {n * (n + 1) / 2}"


SQL = {
    "c_impulses": f"{_PIVOT_ROWS} SELECT ticker, ts, side, {r('price')} AS price, {r('side * (p3 - p4) / nullif(side * (p3 - p2), 0)')} AS fourth_ratio FROM (SELECT *, {_SIX} FROM pv) WHERE side * (p1 - p0) > 0 AND side * (p2 - p0) > 0 AND side * (p4 - p1) > 0 AND side * (p3 - p2) > least(side * (p1 - p0), side * (price - p4)) AND side * (price - p4) > 0",
    "c_wolfe_waves": f"{_PIVOT_ROWS}, q AS (SELECT *, {_WOLFE} FROM pv), z AS (SELECT *, (p3 - p1) / nullif(b3 - b1, 0) AS s13, (p4 - p2) / nullif(b4 - b2, 0) AS s24 FROM q) SELECT ticker, ts, -side AS side, {r('price')} AS price, {r('p1 + (p4 - p1) / (b4 - b1) * (bar - b1)')} AS target FROM z WHERE side * (p3 - p1) > 0 AND side * (p4 - p1) < 0 AND side * (p4 - p2) > 0 AND side * (price - (p3 + s13 * (bar - b3))) >= 0 AND side * (s24 - s13) > 0",
    "c_harmonics": f"{_PIVOT_ROWS}, q AS (SELECT *, {_FIVE} FROM pv), z AS (SELECT *, abs(b - a) / nullif(abs(a - x), 0) AS rb, abs(c - b) / nullif(abs(b - a), 0) AS rc, abs(price - a) / nullif(abs(a - x), 0) AS rd, abs(price - c) / nullif(abs(b - a), 0) AS cd FROM q WHERE x IS NOT NULL) SELECT ticker, ts, bar, -side AS side, pattern, {r('price')} AS price FROM (SELECT *, CASE WHEN rb BETWEEN 0.55 AND 0.7 AND rc BETWEEN 0.382 AND 0.886 AND rd BETWEEN 0.74 AND 0.82 THEN 'gartley' WHEN rb BETWEEN 0.35 AND 0.55 AND rc BETWEEN 0.382 AND 0.886 AND rd BETWEEN 0.84 AND 0.92 THEN 'bat' WHEN rb BETWEEN 0.72 AND 0.85 AND rc BETWEEN 0.382 AND 0.886 AND rd BETWEEN 1.2 AND 1.7 THEN 'butterfly' WHEN rb BETWEEN 0.35 AND 0.65 AND rc BETWEEN 0.382 AND 0.886 AND rd BETWEEN 1.55 AND 1.7 THEN 'crab' WHEN cd BETWEEN 0.95 AND 1.05 AND rc BETWEEN 0.55 AND 0.85 THEN 'abcd' END AS pattern FROM z) WHERE pattern IS NOT NULL",
    "v_ichimoku_signals": staged(
        [{"te": f"(({hhv('high', 9)}) + ({llv('low', 9)})) / 2", "ki": f"(({hhv('high', 26)}) + ({llv('low', 26)})) / 2", "lo": f"(({hhv('high', 52)}) + ({llv('low', 52)})) / 2", "ch": f"close - {lag('close', 26)}"}, {"mid": "(te + ki) / 2"}, {"sa": lag("mid", 26), "sb": lag("lo", 26)}, {"t": "greatest(sa, sb)", "b": "least(sa, sb)"}, {"t1": lag("t"), "b1": lag("b"), "c1": lag("close"), "te1": lag("te"), "ki1": lag("ki"), "known": "sa IS NOT NULL AND b IS NOT NULL"},
         {"up": "coalesce(te > ki AND te1 <= ki1, false)", "dn": "coalesce(ki > te AND ki1 <= te1, false)"}],
        KEYS | {"cloud": "CASE WHEN known THEN CASE WHEN close > t THEN 1 WHEN close < b THEN -1 ELSE 0 END END", "cloud_green": "coalesce(sa > sb, false)::BIGINT", "tk_grade": "CASE WHEN known THEN CASE WHEN up THEN CASE WHEN close > t THEN 'strong buy' WHEN close < b THEN 'weak buy' ELSE 'neutral buy' END WHEN dn THEN CASE WHEN close < b THEN 'strong sell' WHEN close > t THEN 'weak sell' ELSE 'neutral sell' END ELSE '' END ELSE '' END", "breakout": "coalesce(close > t AND c1 <= t1, false)::BIGINT", "breakdown": "coalesce(b > close AND b1 <= c1, false)::BIGINT", "chikou_up": "coalesce(ch > 0, false)::BIGINT"},
    ),
    "f_volume_more": staged(
        [{"ch": f"close - {lag('close')}", "big": f"coalesce(volume > 2.0 * ({ma('volume', 20)}), false)", "m14": ma("volume", 14), "m28": ma("volume", 28)}, {"side": f"coalesce(last_value(CASE WHEN ch > 10 THEN 1 WHEN ch < -10 THEN -1 END IGNORE NULLS) {SO_FAR}, 0)", "rk": "row_number() OVER (PARTITION BY ticker, big ORDER BY ts DESC)"}],
        KEYS | {"tvi": f"CAST(sum(side * volume) {SO_FAR} AS BIGINT)", "big_rank": "CASE WHEN big AND rk <= 3 THEN rk END", "volume_osc": r("m14 - m28")},
    ),
    "i_swing_and_runs": staged(
        [{"c1": lag("close"), "o1": lag("open"), "pr": f"list(close) OVER ({SPEC} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)", "ch": f"coalesce(close - {lag('close')}, 0)"},
         {"a": "abs(high - c1)", "b": "abs(low - c1)", "sp": "abs(high - low)", "bo": "abs(c1 - o1)", "up": "greatest(ch, 0)", "dn": "greatest(-ch, 0)"},
         {"rr": "CASE WHEN a >= b AND a >= sp THEN a - b / 2 + bo / 4 WHEN b >= a AND b >= sp THEN b - a / 2 + bo / 4 ELSE sp + bo / 4 END", "ru": f"sum((dn = 0)::INT) {SO_FAR}", "rd": f"sum((up = 0)::INT) {SO_FAR}"},
         {"one": "CASE WHEN c1 IS NULL THEN 0 ELSE coalesce(50 * ((close - c1) + 0.5 * (close - open) + 0.25 * (c1 - o1)) / nullif(rr, 0) * greatest(a, b) / 1000.0, 0) END", "pu": "up - sum(dn) OVER (PARTITION BY ticker, ru ORDER BY ts ROWS UNBOUNDED PRECEDING)", "pd": "dn - sum(up) OVER (PARTITION BY ticker, rd ORDER BY ts ROWS UNBOUNDED PRECEDING)"}],
        KEYS | {"asi": r(f"sum(one) {SO_FAR}", 2), "tcf_plus": r(total("pu", 35), 2), "tcf_minus": r(total("pd", 35), 2), "percent_rank": r("CASE WHEN len(pr) = 60 THEN 100.0 * len(list_filter(pr, lambda v: v < close)) / 60 END")},
    ),
    "x_index_overlay": f"WITH {BARS_SQL}, ix AS (SELECT ts, sum(close * volume) / sum(volume) AS c FROM bars GROUP BY ts), n AS (SELECT *, row_number() OVER (ORDER BY ts) AS i FROM ix), s AS (SELECT ts, " + ", ".join(f"CASE WHEN i >= {n} THEN (sum(c * i) OVER w{n} - (i - {n}) * sum(c) OVER w{n}) / {n * (n + 1) / 2} END AS m{n}" for n in (15, 50, 200)) + " FROM n WINDOW " + ", ".join(f"w{n} AS (ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (15, 50, 200)) + f") SELECT b.ticker, b.ts, {r('b.close')} AS close, CASE WHEN m15 > m50 AND m50 > m200 THEN 'bull' WHEN m15 < m50 AND m50 < m200 THEN 'bear' ELSE 'mixed' END AS index_state FROM bars b LEFT JOIN s USING (ts)",
}


_TUNNEL = (13, 21, 34, 55, 144, 169)
SQL["a_vegas_tunnel"] = staged(
    [{"top": "greatest(e144, e169)", "low_": "least(e144, e169)"}],
    KEYS | {
        "stack_up": "(e13 > e21 AND e21 > e34 AND e34 > e55)::BIGINT", "above_tunnel": "(close > top)::BIGINT", "below_tunnel": "(close < low_)::BIGINT",
        "tunnel_up": f"coalesce(close > top AND {lag('close')} <= {lag('top')}, false)::BIGINT",
        "tunnel_down": f"coalesce(low_ > close AND {lag('low_')} <= {lag('close')}, false)::BIGINT",
    },
    source="w",
    ctes=walks.walk({f"e{n}": walks.ema("close", n) for n in _TUNNEL}),
    recursive=True,
)

_GRID = [(a, b) for a in (5, 10, 20) for b in (30, 50, 100)]
_EARNED = {f"x{a}_{b}": f"CASE WHEN coalesce(m{a} > m{b}, false) THEN lead(close) {W} / close - 1 ELSE 0 END" for a, b in _GRID}
SQL["g_parameter_sweep"] = staged(
    [{f"m{n}": ma("close", n) for n in (5, 10, 20, 30, 50, 100)}, _EARNED],
    {"ticker": "ticker"} | {f"profit_{a}_{b}": r(f"sum(x{a}_{b})") for a, b in _GRID},
    tail="GROUP BY ticker",
)
