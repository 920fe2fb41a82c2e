"""Moving averages over a stream whose bars may come late or be corrected.

The state of a ticker is a snapshot, the averages after all bars up to some
time, and the list of bars since then.  A bar that is new, late or corrected
takes its place in that list and everything from there on is computed anew from
the snapshot and given out again; whoever stores the result by (ticker, ts) has
what a batch over the right bars would give.  The list keeps the last ``keep``
bars; older ones move into the snapshot.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: (time of the last bar, EMA, mean gain, mean loss, close, changes seen) before the first bar.
START = (None, None, 0.0, 0.0, None, 0)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "ticker string, ts timestamp, close double, ema double, rsi double, too_late boolean"


def fold(state: tuple, ts: int, close: float | None, n: int) -> tuple:
    """The state after one more bar: an EMA from the first close on, and gains and losses whose first n set their means."""
    _, ema, gain, loss, last, seen = state
    if close is None:
        return (ts, *state[1:])
    ema = close if ema is None else ema + (close - ema) * 2 / (n + 1)
    if last is not None:
        up, down = max(close - last, 0.0), max(last - close, 0.0)
        seen += 1
        gain, loss = (gain + up / n, loss + down / n) if seen <= n else (gain + (up - gain) / n, loss + (down - loss) / n)
    return ts, ema, gain, loss, close, seen


def values(state: tuple, n: int) -> tuple[float | None, float | None]:
    _, ema, gain, loss, _, seen = state
    return ema, 100 * gain / (gain + loss) if seen >= n and gain + loss else None


class Averages(StatefulProcessor):
    """EMA and RSI of one ticker; rows are (ticker, us, close), ``us`` being microseconds."""

    def __init__(self, n: int, keep: int):
        self.n, self.keep = n, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.snapshot = handle.getValueState("snapshot", "us long, ema double, gain double, loss double, last double, seen long")
        self.recent = handle.getListState("recent", "us long, close double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = tuple(self.snapshot.get()) if self.snapshot.exists() else START
        bars = {us: close for us, close in self.recent.get()} if self.recent.exists() else {}
        late, first = [], None
        for part in rows:
            for us, close in part[["us", "close"]].itertuples(index=False):
                close = None if pd.isna(close) else float(close)
                if state[0] is not None and us <= state[0]:
                    late.append((us, close))  # its place is inside the snapshot
                elif us not in bars or bars[us] != close:
                    bars[us] = close
                    first = us if first is None else min(first, us)
        out, order = [], sorted(bars)
        now = state
        for i, us in enumerate(order):
            now = fold(now, us, bars[us], self.n)
            if first is not None and us >= first:
                out.append((us, bars[us], *values(now, self.n), False))
            if i < len(order) - self.keep:
                state = now
        if first is not None:
            self.recent.put([(us, bars[us]) for us in order[-self.keep :]])
            if state[0] is not None:
                self.snapshot.update(state)
        out += [(us, close, None, None, True) for us, close in late]
        yield pd.DataFrame({"ticker": key[0], **{name: pd.Series([r[i] for r in out], dtype=kind) for i, (name, kind) in enumerate((("us", "int64"), ("close", "float64"), ("ema", "float64"), ("rsi", "float64"), ("too_late", "bool")))}})

    def close(self) -> None:
        pass


def incremental_averages(bars: DataFrame, n: int = 14, keep: int = 1_000) -> DataFrame:
    """EMA and RSI of each ticker's closes for a stream of (ticker, ts, close), to be stored by (ticker, ts).

    Of several bars of one ticker and time the one that comes last counts (in one
    batch: in any order, so send a bar once a batch).  A null close leaves the
    averages as they are.  A bar older than a ticker's last ``keep`` bars comes
    out marked ``too_late``, without averages, and changes nothing.  The session
    needs the RocksDB state store (``use_rocks``).
    """
    made = bars.select("ticker", F.unix_micros("ts").alias("us"), F.col("close").cast("double").alias("close")).groupBy("ticker")
    out = made.transformWithStateInPandas(Averages(n, keep), "ticker string, us long, close double, ema double, rsi double, too_late boolean", "Update", "None")
    none = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select("ticker", F.timestamp_micros("us").alias("ts"), none("close"), none("ema"), none("rsi"), "too_late")


def use_rocks(spark) -> None:
    """Streams that this session starts from now on keep their state in RocksDB, as lists in state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
