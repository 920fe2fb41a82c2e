"""DuckDB SQL of recurrences: one recursive walk over the bars of all tickers, side by side."""

from __future__ import annotations

from tickloom.plans.bars import BARS_SQL
from tickloom.plans.sqltext import W, over

#: Bars with their ordinal, previous close and true range.
NUMBERED = f"{BARS_SQL}, b AS MATERIALIZED (SELECT *, row_number() {W} AS i, lag(close) {W} AS c1, greatest(high, coalesce(lag(close) {W}, high)) - least(low, coalesce(lag(close) {W}, low)) AS tr FROM bars)"


def walk(smooths: dict[str, tuple[str, str]], ctes: str = NUMBERED, source: str = "b", into: str = "w") -> str:
    """Tables up to ``into``: ``source`` (ticker, ts, i, ...) with y = y + (x - y) * a for each name: (x, a).

    An x may name columns of ``source`` and smooths before it.  A null x leaves y
    as it is; the first x that is not null starts it.
    """
    first = ", ".join(f"CAST({x} AS DOUBLE) AS {n}" for n, (x, _) in smooths.items())
    step = ", ".join(f"CASE WHEN ({x}) IS NULL THEN p_{n} WHEN p_{n} IS NULL THEN ({x}) ELSE p_{n} + (({x}) - p_{n}) * {a} END AS {n}" for n, (x, a) in smooths.items())
    before = ", ".join(f"{n} AS p_{n}" for n in smooths)
    e = "e" if into == "w" else f"{into}_e"
    return f"""{ctes},
{e} AS (SELECT ticker, i, {first} FROM {source} WHERE i = 1
 UNION ALL SELECT src.ticker, src.i, {step} FROM (SELECT ticker AS p_ticker, i AS p_i, {before} FROM {e}) JOIN {source} src ON src.ticker = p_ticker AND src.i = p_i + 1),
{into} AS MATERIALIZED (SELECT {source}.*, {", ".join(f"{e}.{n}" for n in smooths)} FROM {source} JOIN {e} USING (ticker, i))"""


def ema(x: str, n: float) -> tuple[str, str]:
    return x, f"2 / {n + 1}.0"


def wilders(x: str, n: int) -> tuple[str, str]:
    return x, f"1 / {n}.0"


#: MACD (12, 26) and its signal (9).
MACD = {"e12": ema("close", 12), "e26": ema("close", 26), "macd": ("e12 - e26", "1"), "signal": ema("macd", 9)}
#: The directional movement of 14 bars.
DIRECTIONAL = {
    "s_tr": wilders("CASE WHEN i > 1 THEN tr END", 14), "s_plus": wilders("dm_plus", 14), "s_minus": wilders("dm_minus", 14), "plus": ("100 * s_plus / nullif(s_tr, 0)", "1"), "minus": ("100 * s_minus / nullif(s_tr, 0)", "1"),
    "adx": wilders("100 * abs(plus - minus) / nullif(plus + minus, 0)", 14),
}
_UP, _DOWN = f"(high - lag(high) {W})", f"(lag(low) {W} - low)"
#: ``b`` with directional movement, and gains and losses seeded by the mean of the first 14.
RICH = f"""{NUMBERED}, c AS MATERIALIZED (SELECT *, CASE WHEN i > 1 THEN CASE WHEN {_UP} > {_DOWN} AND {_UP} > 0 THEN {_UP} ELSE 0 END END AS dm_plus,
 CASE WHEN i > 1 THEN CASE WHEN {_DOWN} > {_UP} AND {_DOWN} > 0 THEN {_DOWN} ELSE 0 END END AS dm_minus,
 CASE WHEN i = 15 THEN avg(greatest(close - c1, 0)) {over(14)} WHEN i > 15 THEN greatest(close - c1, 0) END AS gain,
 CASE WHEN i = 15 THEN avg(greatest(c1 - close, 0)) {over(14)} WHEN i > 15 THEN greatest(c1 - close, 0) END AS loss FROM b)"""
#: RSI (14) over ``RICH``.
RSI = {"s_gain": wilders("gain", 14), "s_loss": wilders("loss", 14), "rsi": ("100 * s_gain / nullif(s_gain + s_loss, 0)", "1")}
