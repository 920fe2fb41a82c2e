"""Streams of ticks and bars: bar building, running VWAP and expected volume, alerts and incremental reloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.indicators import expected_volume
from tickloom.sources.merge import keep_last
from tickloom.sources.parts import put


def tick_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def live_bars(ticks: DataFrame, width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Bars of (ticker, window) from ticks (ticker, ts, seq, price, volume); with output mode update the running bar is provisional.  Ticks later than ``late`` are dropped."""
    key = F.struct("ts", "seq", "price")
    made = ticks.withWatermark("ts", late).groupBy("ticker", F.window("ts", width).alias("w")).agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.sum("volume").alias("volume"))
    return made.select("ticker", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def live_vwap(ticks: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each ticker's running day: volume-weighted price, volume, its last tick, and the volume to expect of the whole day at this pace."""
    made = ticks.withWatermark("ts", late).groupBy("ticker", F.window("ts", "1 day").alias("w")).agg((F.sum(F.col("price") * F.col("volume")) / F.sum("volume")).alias("vwap"), F.sum("volume").alias("volume"), F.max("ts").alias("last_ts"))
    return made.select("ticker", F.col("w.start").alias("session"), "vwap", "volume", "last_ts", expected_volume("volume", "last_ts").alias("expected"))


def alerts(averages: DataFrame, low: float = 30, high: float = 70) -> DataFrame:
    """Rows whose RSI is beyond a threshold, with the alert's text."""
    return averages.where((F.col("rsi") < low) | (F.col("rsi") > high)).withColumn("alert", F.when(F.col("rsi") < low, "oversold").otherwise("overbought"))


def upsert_stream(stream: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str, available_now: bool = True, mode: str = "update", by: list[str] | None = None, buckets: int = 64):
    """Merge each batch into the bucketed table at ``path``: of rows of one key the last counts, and a later batch wins over the table.

    Only the buckets that a batch touches are written.  The table remembers the
    last batch of this ``checkpoint``, so one that is repeated after a failure
    changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        put(batch.sparkSession, path, keep_last(batch, keys, order), keys, by, buckets, tag=[checkpoint, number])

    writer = stream.writeStream.outputMode(mode).foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
