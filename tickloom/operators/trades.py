"""Tables of trades made from signals, and what they earned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.frame import Frame, as_column


def ledger(f: Frame, buy: Column, sell: Column) -> DataFrame:
    """One row per trade: entry at the open after a buy signal, exit at the open after the next sell signal; open trades have no exit."""
    fill, on = f.hold(f.ref("open", 1)), f.hold(f.ref("ts", 1))
    held = f.hold(f.flip(f.hold(buy & ~F.coalesce(sell, F.lit(False))), sell))
    before = f.hold(F.coalesce(F.lag(held).over(f.w), F.lit(False)))
    events = f.df.where(held != before).select("ticker", "ts", held.alias("enter"), fill.alias("price"), on.alias("filled"))
    w = Window.partitionBy("ticker").orderBy("ts")
    paired = events.withColumn("exit_ts", F.lead("filled").over(w)).withColumn("exit_price", F.lead("price").over(w))
    out = paired.where("enter and filled is not null").select("ticker", F.col("filled").alias("entry_ts"), F.col("price").alias("entry_price"), "exit_ts", "exit_price")
    return out.withColumn("profit", F.try_divide(F.col("exit_price"), F.col("entry_price")) - 1)


def excursions(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Bars, worst and best excursion of each closed trade, in percent of its entry.

    A trade starts on a bar, and a ticker's trades follow one another, so each bar
    carries the last trade that has started: one window over the bars, whatever
    the number of trades.
    """
    starts = trades.select("ticker", F.col("entry_ts").alias("ts"), F.struct("entry_ts", "entry_price", "exit_ts", "profit").alias("trade"))
    w = Window.partitionBy("ticker").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    inside = bars.join(starts, ["ticker", "ts"], "left").withColumn("trade", F.last("trade", ignorenulls=True).over(w)).where(F.col("ts") < F.col("trade.exit_ts"))
    rate = lambda x: 100 * (x / F.col("trade.entry_price") - 1)
    found = inside.groupBy("ticker", "trade").agg(F.count("*").alias("length"), F.min(rate(F.col("low"))).alias("mae"), F.max(rate(F.col("high"))).alias("mfe"))
    return found.select("ticker", "trade.*", "length", "mae", "mfe")


def equity(trades: DataFrame) -> DataFrame:
    """Compounded equity and drawdown of each ticker's closed trades."""
    w = Window.partitionBy("ticker").orderBy("exit_ts", "entry_ts").rowsBetween(Window.unboundedPreceding, 0)
    grown = trades.where("profit is not null").withColumn("equity", F.exp(F.sum(F.log1p("profit")).over(w)))
    return grown.withColumn("drawdown", 100 * (F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(w)) - 1))


def monthly_returns(bars: DataFrame) -> DataFrame:
    """Return of each month against the close before it, per ticker; pivot with ``return_table``."""
    month = bars.groupBy("ticker", F.year("ts").alias("year"), F.month("ts").alias("month")).agg(F.max_by("close", "ts").alias("close"))
    before = F.lag("close").over(Window.partitionBy("ticker").orderBy("year", "month"))
    return month.withColumn("monthly", 100 * (F.try_divide(F.col("close"), before) - 1))


def return_table(monthly: DataFrame) -> DataFrame:
    """Years down, months across, averaged over tickers."""
    return monthly.groupBy("year").pivot("month", list(range(1, 13))).agg(F.avg("monthly"))


def buy_and_hold(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.min_by("close", "ts").alias("first_close"), F.max_by("close", "ts").alias("final_close"), F.count("*").alias("n_bars")).withColumn("hold_return", 100 * (F.try_divide(F.col("final_close"), F.col("first_close")) - 1))


def range_statistics(bars: DataFrame, begin, end) -> DataFrame:
    """Days, bars and gain of each ticker between two dates."""
    rows = bars.where((F.col("ts") >= begin) & (F.col("ts") <= end))
    return rows.groupBy("ticker").agg(F.datediff(F.max("ts"), F.min("ts")).alias("days"), F.count("*").alias("n_bars"), (100 * (F.try_divide(F.max_by("close", "ts"), F.min_by("close", "ts")) - 1)).alias("gain"))


def targets(f: Frame, buy, short, long_stop, short_stop, multiples: tuple[float, ...] = (1, 2, 4)) -> dict[str, Column]:
    """While a long or short position runs, whether the bar passed the entry plus so many times the first risk."""
    buy, short = (F.coalesce(as_column(x), F.lit(False)) for x in (buy, short))
    long = f.hold(f.flip(buy, short))
    down = f.hold(f.flip(short, buy))
    at = f.hold_all({
        "buy": f.value_when(buy, "close"), "stop": f.value_when(buy, long_stop),
        "short": f.value_when(short, "close"), "cover": f.value_when(short, short_stop),
    })
    out = {}
    for i, m in enumerate(multiples, 1):
        up = long & (F.col("high") > at["buy"] + m * (at["buy"] - at["stop"]))
        low = down & (F.col("low") < at["short"] - m * (at["cover"] - at["short"]))
        out |= {f"long_{i}": F.coalesce(up, F.lit(False)), f"short_{i}": F.coalesce(low, F.lit(False))}
    return out
