"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session that names none (a test) gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tickloom-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps whose results have been settled.

    It does so once the driver's garbage is collected, which a driver with little
    to do puts off while files pile up.
    """
    gc.collect()
    spark._jvm.System.gc()


def forget(df: DataFrame) -> None:
    """Delete the files of a settled ``df`` that nothing will read again; a cluster's blocks make even small ones count."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name in any letter case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


#: A key that holds more than one in so many of all rows is frequent; so there are fewer such keys than this.
FREQUENT_SHARE = 100_000


def shared_frequent(rows: DataFrame, totals: DataFrame, keys: list[str], weight: str, share: int = FREQUENT_SHARE) -> DataFrame:
    """``rows`` joined (nulls equal) to ``totals``, which has one row for each key and the key's number of rows in ``weight``.

    Keys with more than a ``share``-th of the summed weight number fewer than
    ``share`` whatever the data: these are broadcast, and their rows stay where
    they are.  No key of the rest is frequent, so the shuffle that joins them has
    no hot partition.
    """
    least = (totals.agg(F.sum(weight)).first()[0] or 0) // share
    names = [f"_{i}_of_total" for i in range(len(keys))]
    other = totals.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[c for c in totals.columns if c not in keys])
    same = reduce(Column.__and__, [rows[k].eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    often, rare = other.where(F.col(weight) > least), other.where(F.col(weight) <= least)
    near = rows.join(F.broadcast(often), same)
    far = rows.join(F.broadcast(often.select(*names)), same, "left_anti").join(rare, same)
    return near.union(far).drop(*names)
