"""Compression of bars to coarser frames, and the way back."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.frame import Frame
from tickloom.functions.recur import Bars, ref

UNITS = {"W": "week", "M": "month", "Q": "quarter", "Y": "year", "D": "day"}


def period(ts, frame: str) -> Column:
    """Start of the period that holds ``ts``: D, W, M, Q, Y, or a window such as "15 minutes"."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.date_trunc(UNITS[frame], ts).cast("date") if frame in UNITS else F.window(ts, frame)["start"]


def compress(bars: DataFrame, frame: str) -> DataFrame:
    """One bar for each ticker and period, with the period's start in ``ts`` and its last bar in ``last_ts``."""
    rows = bars.select("ticker", "ts", "open", "high", "low", "close", "volume", period("ts", frame).alias("p"))
    return rows.groupBy("ticker", "p").agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.max("ts").alias("last_ts")
    ).withColumnRenamed("p", "ts")


def expand(bars: DataFrame, coarse: DataFrame, frame: str, columns: list[str], look_ahead: bool = False) -> DataFrame:
    """``bars`` with the columns of a coarser frame: of the last completed period, or with ``look_ahead`` of the one that runs."""
    f = Frame(coarse)
    shown = {c: F.col(c) if look_ahead else f.ref(c, -1) for c in columns}
    right = f.df.select("ticker", F.col("ts").alias("p"), *[v.alias(c) for c, v in shown.items()])
    return bars.withColumn("p", period("ts", frame)).join(right, ["ticker", "p"], "left").drop("p")


def _compressed(b: Bars, unit: str) -> tuple[Bars, np.ndarray]:
    """One ticker's bars of a period, and the period of each bar."""
    days = pd.to_datetime(b.t).to_numpy().astype("datetime64[D]")
    start = (days.astype(np.int64) + 3) // 7 if unit == "W" else days.astype("datetime64[M]").astype(np.int64)  # day 0 was a Thursday
    first = np.flatnonzero(np.append(True, start[1:] != start[:-1]))
    last = np.append(first[1:], b.n) - 1
    p = Bars(pd.DataFrame({"open": b.o[first], "high": np.maximum.reduceat(b.h, first), "low": np.minimum.reduceat(b.l, first), "close": b.c[last], "volume": np.add.reduceat(b.v, first)}))
    return p, np.searchsorted(first, np.arange(b.n), "right") - 1


def on_periods(b: Bars, unit: str, of: Callable[[Bars], np.ndarray]) -> np.ndarray:
    """``of`` computed on one ticker's bars compressed to periods ("W" or "M"), on every bar the value of the last period that was complete before it.

    For grouped scans: the ticker's bars hold all its periods, so no second shuffle is needed.
    """
    p, period_of = b.once(_compressed, unit)
    return ref(of(p), -1)[period_of]


def price_of(bars: DataFrame, field: str, frame: str, shift: int = -1, name: str = "value") -> DataFrame:
    """A field of the bar ``shift`` periods away, on every fine bar."""
    f = Frame(compress(bars, frame))
    right = f.df.select("ticker", F.col("ts").alias("p"), (f.ref(field, shift) if shift else F.col(field)).alias(name))
    return bars.withColumn("p", period("ts", frame)).join(right, ["ticker", "p"], "left").drop("p")


def week_end_value(f: Frame, x) -> Column:
    """The value on the last bar of each week, held until the next week's end; a bar ends its week if the next one's weekday is less (looks ahead by a bar)."""
    day = F.weekday(F.col(f.order))
    ends = f.hold(day > F.lead(day).over(f.w))
    return f.value_when(ends, x)


def session_flags(f: Frame) -> dict[str, Column]:
    day = f.hold(F.to_date(F.col(f.order)))
    return {"new_session": F.coalesce(day != f.ref(day, -1), F.lit(True)), "last_of_session": F.coalesce(day != f.ref(day, 1), F.lit(True))}


def last_thursday(ts="ts") -> Column:
    """Whether a date is the last Thursday of its month."""
    day = F.to_date(F.col(ts) if isinstance(ts, str) else ts)
    end = F.last_day(day)
    return day == F.date_sub(end, (F.dayofweek(end) + 2) % 7)
