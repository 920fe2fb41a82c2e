"""Writes with merge semantics on plain Parquet tables: upserts, replace by key, aligned selects, the holiday flag."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, NumericType, TimestampNTZType, TimestampType


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key the last in ``order``."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def normalise_key(df: DataFrame, key: str) -> DataFrame:
    """The key trimmed and in upper case; rows without one go."""
    return df.withColumn(key, F.upper(F.trim(F.col(key).cast("string")))).where(F.col(key).isNotNull() & (F.col(key) != ""))


def scrub(df: DataFrame, pattern: str = r"\p{Cntrl}") -> DataFrame:
    """All string columns without what matches ``pattern``."""
    return df.select(*[F.regexp_replace(n, pattern, "").alias(n) if t == "string" else F.col(n) for n, t in df.dtypes])


def merged(target: DataFrame, updates: DataFrame, keys: list[str], evolve: bool = False) -> DataFrame:
    """``target`` with the rows of ``updates`` in place of those of equal keys, and its new ones.

    Columns that ``target`` lacks are ignored, or with ``evolve`` added; columns
    that ``updates`` lacks become null in its rows.  Null keys never equal.  Of
    updates of one key any one counts; use ``keep_last`` first to choose.
    """
    if not evolve:
        updates = updates.select(*[c for c in updates.columns if c in target.columns])
    both = target.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()
    once = keep_last(both.where(known), keys, ["_new"])
    return once.unionByName(both.where(~known)).drop("_new")


def swap(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write beside ``path`` and put the new table in the place of the old one by two renames.

    A reader that comes between the two finds no table; whoever needs more keeps a
    catalogue.  If a rename fails the old table is back in its place.
    """
    staged, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    if fs.exists(at(path)) and not fs.rename(at(path), at(old)):  # a rename into a folder that exists would move the table inside it
        raise OSError(f"could not move {path} away; the new table is in {staged}")
    if not fs.rename(at(staged), at(path)):
        if fs.exists(at(old)):
            fs.rename(at(old), at(path))
        raise OSError(f"could not put {staged} in place of {path}")
    if fs.exists(at(old)):
        fs.delete(at(old), True)


def upsert(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], evolve: bool = False, reload: bool = False) -> None:
    """Merge ``updates`` into the table at ``path``; with ``reload``, or if there is none, they become the table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if reload or not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        swap(spark, updates, path)
    else:
        swap(spark, merged(spark.read.parquet(path), updates, keys, evolve), path)


def last_days(ts: str, days: int, now=None) -> Column:
    """Whether ``ts`` is no older than ``days`` before ``now`` (a date; the current one by default)."""
    return F.col(ts) >= F.date_sub(F.current_date() if now is None else F.lit(now).cast("date"), days)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace the partitions whose values of ``by`` occur in ``df``, leaving the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def family(kind: DataType) -> str:
    return "number" if isinstance(kind, NumericType) else "time" if isinstance(kind, (DateType, TimestampType, TimestampNTZType)) else kind.typeName()


def aligned(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, cast to its types; what is missing or cannot be cast is null, other columns are left out."""
    one = lambda f: (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
    return df.select(*[one(f) for f in like.schema.fields])


def calendar(spark: SparkSession, begin, end) -> DataFrame:
    """FullDate and DayNameOfWeek of every day from ``begin`` to ``end``."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(begin).cast("date"), F.lit(end).cast("date"))).alias("FullDate"))
    return days.withColumn("DayNameOfWeek", F.date_format("FullDate", "EEEE"))


def with_holidays(days: DataFrame, trading: DataFrame, weekend_names: tuple[str, ...] = ("Saturday", "Sunday")) -> DataFrame:
    """isHoliday = 'Y' for days outside ``weekend_names`` without a row in ``trading`` (column ts), else 'N'."""
    closed = days.join(trading.select(F.col("ts").alias("FullDate")).distinct(), "FullDate", "left_anti").where(~F.col("DayNameOfWeek").isin(*weekend_names)).select("FullDate", F.lit("Y").alias("isHoliday"))
    return days.join(closed, "FullDate", "left").withColumn("isHoliday", F.coalesce("isHoliday", F.lit("N")))


def blank_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.nullif(F.trim(n), F.lit("")).alias(n) if t == "string" else F.col(n) for n, t in df.dtypes])


def number(c: str | Column) -> Column:
    """Text with thousands separators as a number, or null."""
    return F.regexp_replace(F.trim(c), ",", "").try_cast("double")


def quarter_start(label: str | Column) -> Column:
    """First day of the quarter in a label such as "Q1/2024" or "Quý 1/2024"; null unless the quarter is 1 to 4."""
    q, y = F.regexp_extract(label, r"([0-9]+)\s*/\s*[0-9]{4}\s*$", 1), F.regexp_extract(label, r"([0-9]{4})\s*$", 1)
    return F.when(q.isin("1", "2", "3", "4"), F.make_date(y.cast("int"), q.cast("int") * 3 - 2, F.lit(1)))


def quarterly_mart(income: DataFrame, balance: DataFrame, ratios: DataFrame) -> DataFrame:
    """Full outer join of the three statements on ticker and quarter; columns of the latter two carry a suffix."""
    tag = lambda df, s: df.select("ticker", "quarter", *[F.col(c).alias(f"{c} ({s})") for c in df.columns if c not in ("ticker", "quarter")])
    out = income.join(tag(balance, "balance"), ["ticker", "quarter"], "full").join(tag(ratios, "ratios"), ["ticker", "quarter"], "full")
    return out.withColumn("quarter_start", quarter_start("quarter"))
