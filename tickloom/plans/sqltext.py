"""Writes the DuckDB SQL that the queries are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.plans.bars import BARS_SQL

SPEC = "PARTITION BY ticker ORDER BY ts"


def over(n: int) -> str:
    return f"OVER ({SPEC} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


W = f"OVER ({SPEC})"
SO_FAR = f"OVER ({SPEC} ROWS UNBOUNDED PRECEDING)"


def full(agg: str, x: str, n: int, count: str | None = None) -> str:
    """``agg`` with {w} for the window, null until n values of ``x`` are there."""
    return f"CASE WHEN count({count or x}) {over(n)} >= {n} THEN {agg.format(x=x, w=over(n))} END"


def ma(x: str, n: int) -> str:
    return full("avg({x}) {w}", x, n)


def hhv(x: str, n: int) -> str:
    return full("max({x}) {w}", x, n)


def llv(x: str, n: int) -> str:
    return full("min({x}) {w}", x, n)


def total(x: str, n: int) -> str:
    return full("sum({x}) {w}", x, n)


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) {W}"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif(({b}), 0))"


def staged(steps: list[dict[str, str]], out: dict[str, str], source: str = "bars", ctes: str = BARS_SQL, tail: str = "", recursive: bool = False) -> str:
    """Common tables s1, s2, ... that each add columns to the one before, and a final selection."""
    parts, last = [ctes], source
    for i, step in enumerate(steps, 1):
        parts.append(f"s{i} AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in step.items()) + f" FROM {last})")
        last = f"s{i}"
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\nSELECT " + ", ".join(f"{e} AS {n}" for n, e in out.items()) + f" FROM {last} {tail}"


def r(x: str, digits: int = 4) -> str:
    """``x`` rounded as ``rounded`` rounds it: by the same arithmetic in both engines, with halves (and noise around them) going up."""
    return f"floor(({x}) * {10**digits} + 0.50001) / {10**digits}"


def rounded(x, digits: int = 4):
    return F.floor(x * 10**digits + 0.50001) / 10**digits


KEYS = {"ticker": "ticker", "ts": "ts"}
