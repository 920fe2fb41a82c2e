"""Queries of parameter sweeps and of volume at price by segment."""

from __future__ import annotations

from tickloom.operators import crosssection, parameters
from tickloom.plans.bars import BARS_SQL, INTRADAY_SQL, bars_eod, bars_intraday
from tickloom.plans.series_queries import tidy
from tickloom.plans.sqltext import W, div, hhv, llv, ma, r, staged

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(make):
        QUERIES[name] = make
        if sql:
            SQL[name] = sql
        return make

    return register


def _profits(flags: dict[tuple, str], names: tuple[str, ...], steps: list[dict[str, str]]) -> str:
    """Profit and trades of each point, whose flag says on which bars a position is held."""
    held = {f"h{i}": f"coalesce({x}, false)" for i, x in enumerate(flags.values())}
    base = staged([{"nxt": f"lead(close) {W} / close - 1"} | steps[0], *steps[1:], held, {f"e{i}": f"{h} AND NOT coalesce(lag({h}) {W}, false)" for i, h in enumerate(held)}], {"ticker": "ticker", "ts": "ts", "nxt": "nxt"} | {x: x for i in range(len(flags)) for x in (f"h{i}", f"e{i}")})
    one = lambda i, values: f"SELECT ticker, {', '.join(f'{v} AS {n}' for n, v in zip(names, values))}, {r(f'sum(CASE WHEN h{i} THEN coalesce(nxt, 0) ELSE 0 END)', 3)} AS profit, CAST(sum(e{i}::INT) AS BIGINT) AS trades FROM m GROUP BY ticker"
    return f"WITH m AS MATERIALIZED ({base}) " + " UNION ALL ".join(one(i, v) for i, v in enumerate(flags))


_CROSS = {(a, b): f"m{a} > m{b}" for a in range(5, 21, 5) for b in range(30, 71, 10)}


@query("g_average_grid", _profits(_CROSS, ("fast", "slow"), [{f"m{n}": ma("close", n) for n in sorted({x for p in _CROSS for x in p})}]))
def _(spark, d):
    """Profit of the cross of two averages over a grid of their lengths."""
    return tidy(parameters.sweep(bars_eod(spark, d), "average_cross", {"fast": (5, 20, 5), "slow": (30, 70, 10)}), 3)


_STOCH = {(n, s, m): f"k{n}_{s} - d{n}_{s}_{m} > 1e-9" for n in range(8, 15, 3) for s in (2, 3, 4, 5) for m in (2, 5)}
_K = sorted({p[:2] for p in _STOCH})


@query(
    "g_stochastic_grid",
    _profits(
        _STOCH,
        ("range", "k_smooth", "d_smooth"),
        [
            {f"hh{n}": hhv("high", n) for n, s in _K if s == 2} | {f"ll{n}": llv("low", n) for n, s in _K if s == 2},
            {f"raw{n}": f"100 * {div(f'close - ll{n}', f'hh{n} - ll{n}')}" for n, s in _K if s == 2},
            {f"k{n}_{s}": ma(f"raw{n}", s) for n, s in _K},
            {f"d{n}_{s}_{m}": ma(f"k{n}_{s}", m) for n, s, m in _STOCH},
        ],
    ),
)
def _(spark, d):
    """Profit of holding while the stochastic is over its mean, over three lengths each with a range and a step of its own."""
    return tidy(parameters.sweep(bars_eod(spark, d), "stochastic_cross", {"range": (8, 14, 3), "d_smooth": (2, 5, 3)}, chunk=8), 3)


def _at_price(ctes: str, segment: str, bins: int = 24) -> str:
    return f"""WITH {ctes}, s AS (SELECT *, {segment} AS segment FROM x), e AS (SELECT ticker, segment, min(low) AS lo, max(high) AS hi FROM s GROUP BY ticker, segment),
w AS (SELECT s.*, lo, (hi - lo) / {bins} AS width FROM s JOIN e USING (ticker, segment)),
b AS (SELECT *, unnest(range({bins})) AS bin FROM w WHERE width > 0), f AS (SELECT *, lo + bin * width AS floor_, lo + (bin + 1) * width AS top_ FROM b),
p AS (SELECT ticker, segment, bin, floor_, volume * (CASE WHEN high > low THEN greatest(0, least(high, top_) - greatest(low, floor_)) / (high - low) WHEN bin = least({bins - 1}, floor((low - lo) / width)) THEN 1 ELSE 0 END) AS part FROM f
 UNION ALL SELECT ticker, segment, 0, lo, volume FROM w WHERE width = 0)
SELECT ticker, segment, CAST(bin AS BIGINT) AS bin, {r('min(floor_)', 2)} AS price, {r('sum(part)', 2)} AS volume FROM p GROUP BY ticker, segment, bin HAVING sum(part) > 1e-6"""


@query("f_volume_at_price_months", _at_price(f"{BARS_SQL}, x AS (SELECT * FROM bars)", "CAST(date_trunc('month', ts) AS DATE)"))
def _(spark, d):
    """Each month's volume by 24 equal steps of the month's own range, spread over the range of each bar."""
    return tidy(crosssection.volume_by_price(bars_eod(spark, d), "month"), 2)


@query("f_volume_at_price_days", _at_price(f"{INTRADAY_SQL.format(width='15 minutes')}, x AS (SELECT * FROM intraday)", "CAST(date_trunc('day', ts) AS DATE)"))
def _(spark, d):
    return tidy(crosssection.volume_by_price(bars_intraday(spark, d, "15 minutes"), "day"), 2)
