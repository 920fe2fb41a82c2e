"""Typed parameters with bounds and a step, and sweeps of trading rules over their grids.

A grid is never a table: its points are numbered, and the number of a point
gives its values.  A sweep sends each ticker's bars once to every ``CHUNK``
points, so tasks are as many as tickers times chunks and hold one ticker each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import recur as k

#: Grid points that one task tries on a ticker's bars.
CHUNK = 256
ROUNDING = 1e-9


@dataclass(frozen=True)
class Param:
    """A number from ``low`` to ``high`` in steps of ``step`` from ``low``; whole if low, high and step are."""

    name: str
    default: float
    low: float
    high: float
    step: float = 1

    def __post_init__(self):
        if not self.low <= self.high or self.step <= 0:
            raise ValueError(f"{self.name}: {self.low} to {self.high} by {self.step} is no range")
        self.check(self.default)

    @property
    def whole(self) -> bool:
        return all(float(x).is_integer() for x in (self.low, self.high, self.step))

    def __len__(self) -> int:
        return int(math.floor((self.high - self.low) / self.step + 1e-9)) + 1

    def at(self, i: int) -> float:
        value = self.low + i * self.step
        return int(value) if self.whole else round(value, 12)

    def check(self, value) -> float:
        """``value`` as this parameter's type; a value of another type, out of range or between steps is an error."""
        if isinstance(value, bool) or not isinstance(value, (int, float, np.integer, np.floating)):
            raise TypeError(f"{self.name} is a number, not {value!r}")
        steps = (value - self.low) / self.step
        if not self.low <= value <= self.high or abs(steps - round(steps)) > 1e-6:
            raise ValueError(f"{self.name} goes from {self.low} to {self.high} by {self.step}, which {value!r} does not fit")
        return self.at(round(steps))

    def narrowed(self, low: float, high: float, step: float | None = None) -> Param:
        """The same parameter with fewer values, all of them of this one."""
        step = self.step if step is None else step
        low, high = self.check(low), self.check(low + math.floor((high - low) / step + 1e-9) * step)
        self.check(min(self.high, low + step) if low + step > self.high else low + step)
        return Param(self.name, low, low, high, step)


def points(params: Iterable[Param]) -> int:
    return math.prod(map(len, params))


def point(params: list[Param], number: int) -> dict[str, float]:
    """The values of a numbered point; the last parameter changes fastest."""
    out = {}
    for p in reversed(params):
        number, i = divmod(number, len(p))
        out[p.name] = p.at(i)
    return {p.name: out[p.name] for p in params}


#: Rule of (bars, **values) -> whether a position is held after each bar, with its parameters.
Rule = tuple[Callable[..., np.ndarray], tuple[Param, ...]]
RULES: dict[str, Rule] = {}


def rule(*params: Param):
    def register(make: Callable[..., np.ndarray]):
        RULES[make.__name__] = make, params
        return make

    return register


def linear_end(x: np.ndarray, n: int) -> np.ndarray:
    """End of the least-squares line of the last n values."""
    return 3 * k.wma(x, n) - 2 * k.ma(x, n) if n > 1 else x


@rule(Param("fast", 10, 1, 200), Param("slow", 50, 2, 500))
def average_cross(b: k.Bars, fast: int, slow: int) -> np.ndarray:
    return k.ma(b.c, fast) > k.ma(b.c, slow)


@rule(Param("range", 8, 8, 14), Param("k_smooth", 3, 2, 5), Param("d_smooth", 3, 2, 5))
def stochastic_cross(b: k.Bars, range: int, k_smooth: int, d_smooth: int) -> np.ndarray:
    line = k.stoch_k(b, range, k_smooth)
    return line - k.ma(line, d_smooth) > ROUNDING  # the line rests at 0 and 100, where only rounding parts it from its mean


@rule(Param("fast", 17, 1, 20), Param("slow", 5, 2, 20), Param("level", -310_000, -500_000, 50_000, 10_000))
def force_index(b: k.Bars, fast: int, slow: int, level: int) -> np.ndarray:
    force = (b.c - k.ref(b.c, -1)) * b.v
    return (linear_end(force, fast) > linear_end(force, slow)) & (linear_end(force, fast) > level)


@rule(Param("length", 10, 2, 100), Param("hot", 0.618, 0, 1, 0.001))
def t3_rise(b: k.Bars, length: int, hot: float) -> np.ndarray:
    line = k.t3(b.c, length, hot)
    return line > k.ref(line, -1)


def values_of(name: str, **given) -> dict[str, float]:
    """The rule's parameters, those not given at their defaults; unknown names and bad values are errors."""
    params = {p.name: p for p in RULES[name][1]}
    if unknown := given.keys() - params.keys():
        raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    return {n: p.check(given.get(n, p.default)) for n, p in params.items()}


def sweep(bars: DataFrame, name: str, grid: dict[str, tuple] | None = None, chunk: int = CHUNK) -> DataFrame:
    """(ticker, parameters, profit, trades) of a registered rule at every point of its grid.

    ``grid`` narrows parameters to (low, high) or (low, high, step); those it
    doesn't name go over their whole range.  A position is held from one close to
    the next; profit is the sum of the changes, trades the number of entries.
    """
    make, params = RULES[name]
    if unknown := (grid or {}).keys() - {p.name for p in params}:
        raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    params = [p.narrowed(*grid[p.name]) if grid and p.name in grid else p for p in params]
    total = points(params)

    def run(key: tuple, g: pa.Table) -> pa.Table:
        ticker, at = (x.as_py() for x in key)
        b, rows = k.Bars(g.combine_chunks().take(pa.array(np.argsort(g["ts"].to_numpy(), kind="stable")))), []
        change = k.div(k.ref(b.c, 1), b.c) - 1
        with np.errstate(all="ignore"), k.keeping():  # the points share windows of equal lengths
            for number in range(at * chunk, min(total, (at + 1) * chunk)):
                values = point(params, number)
                held = np.asarray(make(b, **values), bool)
                entries = held & ~np.concatenate(([False], held[:-1]))
                rows.append((ticker, *values.values(), float(np.nansum(np.where(held, change, 0.0))), int(entries.sum())))
        columns = zip(*rows)
        kinds = (pa.string(), *(pa.int64() if p.whole else pa.float64() for p in params), pa.float64(), pa.int64())
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["ticker", *(p.name for p in params), "profit", "trades"])

    schema = "ticker string, " + "".join(f"{p.name} {'long' if p.whole else 'double'}, " for p in params) + "profit double, trades long"
    chunks = F.explode(F.sequence(F.lit(0), F.lit((total - 1) // chunk))).alias("chunk")
    return bars.select("ticker", "ts", "open", "high", "low", "close", "volume", chunks).groupBy("ticker", "chunk").applyInArrow(run, schema)


def best_points(swept: DataFrame, n: int = 1) -> DataFrame:
    """Each ticker's ``n`` most profitable points; fewer trades, then smaller values, decide ties."""
    from pyspark.sql import Window

    names = [c for c in swept.columns if c not in ("ticker", "profit", "trades")]
    order = Window.partitionBy("ticker").orderBy(F.desc("profit"), "trades", *names)
    return swept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
