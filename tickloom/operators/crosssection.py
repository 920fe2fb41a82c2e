"""Measures across tickers: breadth, ranks, relative strength, baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.frame import Frame

div = F.try_divide


def breadth(bars: DataFrame) -> DataFrame:
    """Per date: advancing, declining and unchanged issues and volumes, and the ratios made of them."""
    f = Frame(bars)
    change = f.hold(F.col("close") - f.ref("close", -1))
    up, down = change > 0, change < 0
    out = f.df.groupBy("ts").agg(
        F.count_if(up).alias("advancing"), F.count_if(down).alias("declining"), F.count_if(change == 0).alias("unchanged"), F.sum(F.when(up, F.col("volume")).otherwise(0)).alias("up_volume"), F.sum(F.when(down, F.col("volume")).otherwise(0)).alias("down_volume")
    )
    a, d = F.col("advancing"), F.col("declining")
    return out.withColumns({"absolute_breadth": F.abs(a - d), "ad_ratio": div(a, d), "thrust": div(a, a + d), "trin": div(div(a, d), div(F.col("up_volume"), F.col("down_volume")))})


def ad_line(by_date: DataFrame) -> DataFrame:
    """Running sum of advancing less declining issues, over dates: one row a date, so one task holds a calendar at most."""
    return by_date.withColumn("ad_line", F.sum(F.col("advancing") - F.col("declining")).over(Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)))


def percent_above_ma(bars: DataFrame, n: int = 10) -> DataFrame:
    f = Frame(bars)
    m = f.hold(f.ma("close", n))
    return f.df.where(m.isNotNull()).groupBy("ts").agg((100 * F.avg((F.col("close") > m).cast("double"))).alias("percent_above"))


def with_index(bars: DataFrame, index: DataFrame) -> DataFrame:
    """Bars with the index columns of their date; dates are a calendar, so Spark broadcasts the index while it is small and joins by date beyond."""
    return bars.join(index, "ts", "left")


def beta(f: Frame, index: str, n: int = 60):
    """Slope of a ticker's returns on the index's over n bars."""
    own, market = f.hold(f.roc("close", 1)), f.hold(f.roc(index, 1))
    return F.when(F.count(F.when(own.isNotNull() & market.isNotNull(), 1)).over(f.back(n)) >= n, F.regr_slope(own, market).over(f.back(n)))


def strength_rank(scored: DataFrame, score: str = "score") -> DataFrame:
    """Percent rank (0 to 100) of the score among a date's tickers with a score."""
    return scored.where(F.col(score).isNotNull()).withColumn("strength", 100 * F.percent_rank().over(Window.partitionBy("ts").orderBy(score)))


def relative_performance(bars: DataFrame, base) -> DataFrame:
    """Close in percent of the first close on or after the base date."""
    start = bars.where(F.col("ts") >= base).groupBy("ticker").agg(F.min_by("close", "ts").alias("base_close"))
    return bars.where(F.col("ts") >= base).join(start, "ticker").withColumn("performance", 100 * (div(F.col("close"), F.col("base_close")) - 1))


def spread(bars: DataFrame, a: str, b: str) -> DataFrame:
    """Difference and ratio of two symbols on the dates that both have."""
    one, two = (bars.where(F.col("ticker") == t).select("ts", F.col("close").alias(n)) for t, n in ((a, "a_close"), (b, "b_close")))
    return one.join(two, "ts").withColumns({"spread": F.col("a_close") - F.col("b_close"), "ratio": div(F.col("a_close"), F.col("b_close"))})


def basket(bars: DataFrame, symbols: str) -> DataFrame:
    """Volume-weighted bars of a comma-separated list of symbols."""
    names = [s.strip() for s in symbols.split(",") if s.strip()]
    sums = [(F.sum(F.col(c) * F.col("volume")) / F.sum("volume")).alias(c) for c in ("open", "high", "low", "close")]
    return bars.where(F.col("ticker").isin(names)).groupBy("ts").agg(*sums, F.sum("volume").alias("volume"))


def correlations(bars: DataFrame, symbols: str, n: int = 252) -> DataFrame:
    """Correlation of every ticker's closes with those of each listed symbol, over the ticker's last n bars.

    A listed symbol has its last known close on each date.  The list becomes one
    row a date (a calendar, whatever the number of tickers), so the bars are
    joined by date once.  ``corr`` is null where fewer than n bars have both
    closes, or one of them does not vary; ``n`` tells how many bars have both.
    """
    names = [s.strip() for s in symbols.split(",") if s.strip()]
    by_date = bars.groupBy("ts").agg(*[F.max(F.when(F.col("ticker") == s, F.col("close"))).alias(s) for s in names])
    so_far = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    listed = by_date.select("ts", *[F.last(s, ignorenulls=True).over(so_far).alias(f"listed_{i}") for i, s in enumerate(names)])
    nth = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("ts")))
    last = bars.select("ticker", "ts", "close").withColumn("nth", nth).where(F.col("nth") <= n).join(listed, "ts")
    both = F.explode(F.array(*[F.struct(F.lit(s).alias("b"), F.col(f"listed_{i}").alias("y")) for i, s in enumerate(names)]))
    pairs = last.select(F.col("ticker").alias("a"), F.col("close").alias("x"), both.alias("l")).select("a", "l.b", "x", "l.y")
    filled = F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1))
    corr = div(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    return pairs.groupBy("a", "b").agg(F.when(filled >= n, corr).alias("corr"), filled.alias("n"))


def risk_yield(bars: DataFrame) -> DataFrame:
    f = Frame(bars)
    change = f.hold(f.roc("close", 1))
    return f.df.groupBy("ticker").agg(F.avg(change).alias("mean_return"), F.stddev_samp(change).alias("risk"), F.count(change).alias("n"))


def top_k(scored: DataFrame, score: str, k: int) -> DataFrame:
    """The k best tickers of each date; ties by ticker."""
    return scored.where(F.col(score).isNotNull()).withColumn("place", F.row_number().over(Window.partitionBy("ts").orderBy(F.desc(score), "ticker"))).where(F.col("place") <= k)


def rotation(scored: DataFrame, score: str, k: int, slack: int = 2) -> DataFrame:
    """``held``: from a bar on which the ticker is among the k best of its date until it is no longer among k + ``slack``."""
    place = F.row_number().over(Window.partitionBy("ts").orderBy(F.desc(score), "ticker"))
    f = Frame(scored.where(F.col(score).isNotNull()).withColumn("place", place))
    return f.add(held=f.flip(F.col("place") <= k, F.col("place") > k + slack)).df


def liquid(f: Frame, least: float, n: int = 20):
    """Whether mean volume times mean close over n bars exceeds ``least``."""
    return F.coalesce(f.ma("volume", n) * f.ma("close", n) > least, F.lit(False))


def sorted_by(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` in the order of its columns; a leading minus sign sorts downwards."""
    return df.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in columns])


def with_summary(df: DataFrame, label: str, **totals: str) -> DataFrame:
    """``df`` and a last row that holds ``label`` in its first column and the named aggregate (sum, avg, min, max, count) of others."""
    first = df.columns[0]
    row = df.agg(*[F.expr(f"{how}({c})").alias(c) for c, how in totals.items()]).withColumn(first, F.lit(label))
    return df.unionByName(row, allowMissingColumns=True)


def stix(by_date: DataFrame) -> DataFrame:
    """Share of advancing issues of each date, as a series to be smoothed."""
    share = 100 * div(F.col("advancing"), F.col("advancing") + F.col("declining"))
    return by_date.select(F.lit("INDEX").alias("ticker"), "ts", share.alias("close"))


def volume_by_price(bars: DataFrame, unit: str = "month", bins: int = 24) -> DataFrame:
    """Volume of each ticker and segment (``unit`` of time) by ``bins`` equal steps of the segment's own price range.

    A bar's volume is spread evenly over its range; a bar without range counts
    in the step of its price, a segment without range has one step.
    """
    cut = bars.withColumn("segment", F.date_trunc(unit, "ts").cast("date"))
    own = Window.partitionBy("ticker", "segment")
    ends = cut.withColumns({"lo": F.min("low").over(own), "width": (F.max("high").over(own) - F.min("low").over(own)) / bins})
    step = lambda x: F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(x) - F.col("lo"), F.col("width")))).cast("int")
    touched = ends.withColumn("bin", F.explode(F.when(F.col("width") > 0, F.sequence(step("low"), step("high"))).otherwise(F.array(F.lit(0)))))
    floor, top = F.col("lo") + F.col("bin") * F.col("width"), F.col("lo") + (F.col("bin") + 1) * F.col("width")
    share = F.when(F.col("high") > F.col("low"), F.greatest(F.lit(0.0), F.least("high", top) - F.greatest("low", floor)) / (F.col("high") - F.col("low"))).otherwise(1.0)
    summed = touched.groupBy("ticker", "segment", "bin").agg(F.min(floor).alias("price"), F.sum(F.col("volume") * share).alias("volume"))
    return summed.where(F.col("volume") > 1e-6)
