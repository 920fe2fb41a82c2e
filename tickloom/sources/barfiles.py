"""Binary bar files, file inventories and tabular files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.merge import keep_last

#: Fixed value: a record is 32 bytes in native order: date as yyyymmdd, time, open, high, low, close, volume, open interest.
RECORD = np.dtype([("d", "<i4"), ("t", "<i4"), ("open", "<f4"), ("high", "<f4"), ("low", "<f4"), ("close", "<f4"), ("volume", "<f4"), ("open_int", "<f4")])
SCHEMA = "path string, record long, d int, t int, open double, high double, low double, close double, volume double, open_int double"


def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for path, content in zip(part["path"], part["content"]):
            rows = np.frombuffer(content[: len(content) // RECORD.itemsize * RECORD.itemsize], RECORD)  # a cut last record is dropped
            yield pd.DataFrame({"path": path, "record": np.arange(len(rows)), **{n: rows[n].astype("int32" if n in "dt" else float) for n in RECORD.names}})


def ticker_of(path: str | Column, suffix: str = "dat") -> Column:
    return F.regexp_extract(path, rf"([^/]+)\.{suffix}$", 1)


def read_bar_files(spark: SparkSession, path: str, since: str | None = None, suffix: str = "dat", intraday: bool = False) -> DataFrame:
    """Bars of every file under ``path``; the folder above a file is its asset class.

    Dates that do not exist or lie outside 1990 to 2050 or before ``since`` are
    dropped; prices are rounded to cents, volume is cut to whole numbers.  Of
    several bars of a ticker and time the last record counts.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return bars_of_records(files.mapInPandas(decode, SCHEMA), since, suffix, intraday)


def bars_of_records(rows: DataFrame, since: str | None, suffix: str, intraday: bool, last: bool = True) -> DataFrame:
    """Bars of decoded records (``SCHEMA``); with ``last`` one for each ticker and time, else all with their ``record``."""
    date = F.try_to_date(F.col("d").cast("string"), "yyyyMMdd")
    clock = F.make_interval(hours=F.floor(F.col("t") / 10000).cast("int"), mins=F.floor(F.col("t") / 100).cast("int") % 100, secs=(F.col("t") % 100).cast("decimal(18,6)"))
    rows = rows.where(F.col("d").between(19900101, 20501231)).withColumn("date", date).where("date is not null")
    if since:
        rows = rows.where(F.col("date") >= F.lit(since).cast("date"))
    money = lambda c: F.round(c, 2).alias(c)
    out = rows.select(
        F.upper(F.trim(ticker_of(F.substring_index("path", "/", -1), suffix))).alias("ticker"),
        (F.col("date").cast("timestamp") + clock if intraday else F.col("date")).alias("ts"),
        *map(money, ("open", "high", "low", "close")),
        F.floor("volume").cast("long").alias("volume"),
        "open_int",
        F.substring_index(F.substring_index("path", "/", -2), "/", 1).alias("asset_class"),
        "record",
    )
    return keep_last(out, ["asset_class", "ticker", "ts"], ["record"]).drop("record") if last else out


def file_inventory(spark: SparkSession, path: str, suffix: str | None = None) -> DataFrame:
    """Name, path, extension and size in KB of the files right under ``path``; the content is not read.  A missing folder is an error."""
    reader = spark.read.format("binaryFile")
    if suffix:
        reader = reader.option("pathGlobFilter", f"*.{suffix}")
    return reader.load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file_name"), F.col("path").alias("file_path"), F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("file_extension"), F.round(F.col("length") / 1024, 2).alias("file_size_kb"))


def read_table_file(spark: SparkSession, paths: list[str], key: str = "Ticker") -> DataFrame:
    """The first of ``paths`` that exists, as CSV with a header or as Parquet; its first column becomes ``key`` if there is none."""
    failure: Exception | None = None
    for path in paths:
        try:
            df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)
            return df if key in df.columns else df.withColumnRenamed(df.columns[0], key)
        except AnalysisException as e:  # the next path is the fallback for one that is not there, not for one that is broken
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            failure = e
    raise failure or ValueError("no paths")


def write_screen(df: DataFrame, path: str, by: str | None = None) -> None:
    """A screen as CSV with a header and without commas or NaN in its values, in a folder for each value of ``by`` if given."""
    kinds = dict(df.dtypes)
    clean = lambda c: F.regexp_replace(c, ",", "") if kinds[c] == "string" else F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)) if kinds[c] == "double" else F.col(c)
    writer = df.select(*[clean(c).alias(c) for c in df.columns]).write.mode("overwrite").option("header", True)
    (writer.partitionBy(by) if by else writer).csv(path)
