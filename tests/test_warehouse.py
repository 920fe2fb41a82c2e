"""Bar files, statements, merges and streams on small fixtures."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.sources import barfiles, merge, statements
from tickloom.sources.parts import PartTable
from tickloom.streaming import live


def test_bar_files(spark, tmp_path):
    folder = tmp_path / "stock"
    folder.mkdir()
    rows = np.array([(20240105, 0, 1.005, 2, 0.5, 1.5, 10.9, 0), (20240231, 0, 1, 1, 1, 1, 1, 0), (19800101, 0, 1, 1, 1, 1, 1, 0), (20240105, 0, 3, 3, 3, 3, 7, 1)], barfiles.RECORD)
    (folder / "abc.dat").write_bytes(rows.tobytes() + b"cut")
    out = barfiles.read_bar_files(spark, str(tmp_path)).collect()
    assert [(r.ticker, r.ts, r.close, r.volume, r.asset_class) for r in out] == [("ABC", datetime.date(2024, 1, 5), 3.0, 7, "stock")]
    assert barfiles.file_inventory(spark, str(folder)).select("file_name", "file_extension").collect() == [("abc.dat", ".dat")]
    with pytest.raises(Exception):
        barfiles.file_inventory(spark, str(tmp_path / "none")).collect()


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.createDataFrame([("A", 1, "x"), ("B", 2, "y"), (None, 3, "z")], "k string, v int, s string")
    new = spark.createDataFrame([("B", 9, 1.0), ("C", 4, 2.0)], "k string, v int, extra double")
    merge.upsert(spark, path, base, ["k"])
    for _ in range(2):
        merge.upsert(spark, path, new, ["k"])
        rows = sorted(spark.read.parquet(path).collect(), key=str)
        assert sorted(map(tuple, rows), key=str) == sorted([("A", 1, "x"), ("B", 9, None), ("C", 4, None), (None, 3, "z")], key=str)
    assert "extra" in merge.merged(base, new, ["k"], evolve=True).columns


def test_replace_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    merge.replace_partitions(spark.createDataFrame([("A", 1), ("B", 2)], "t string, v int"), path, "t")
    merge.replace_partitions(spark.createDataFrame([("A", 5)], "t string, v int"), path, "t")
    assert sorted((r.t, r.v) for r in spark.read.parquet(path).collect()) == [("A", 5), ("B", 2)]


def test_quarters_and_numbers(spark):
    df = spark.createDataFrame([("Q1/2024",), ("Quý 4/2023",), ("Q5/2024",), ("x",), (None,)], "q string")
    assert [r[0] for r in df.select(merge.quarter_start("q")).collect()] == [datetime.date(2024, 1, 1), datetime.date(2023, 10, 1), None, None, None]
    assert [r[0] for r in spark.createDataFrame([("1,234.5",), ("-",), (None,)], "c string").select(merge.number("c")).collect()] == [1234.5, None, None]


def test_holidays_strict_and_corrected(spark):
    days = merge.calendar(spark, datetime.date(2024, 1, 5), datetime.date(2024, 1, 8))  # Friday to Monday
    trading = spark.createDataFrame([(datetime.date(2024, 1, 5),)], "ts date")
    flags = lambda **k: [r.isHoliday for r in merge.with_holidays(days, trading, **k).orderBy("FullDate").collect()]
    assert flags() == ["N", "N", "N", "Y"]
    assert flags(weekend_names=("Sarturday", "Sunday")) == ["N", "Y", "N", "Y"]


HTML = "<table id='t'><thead><tr><th>Item</th><th><b>Q1/2024</b></th><th>Q2/2024</th></tr></thead><tbody><tr><td>Sales</td><td>1,000</td><td></td></tr><tr><td>Sales</td><td>9</td><td>2,000</td></tr><tr><td>Cost</td><td>5</td></tr></tbody></table>"


def test_statement_tables(spark):
    rows = statements.extract_tables(spark.createDataFrame([(1, HTML), (2, None)], "page_id long, html string"))
    assert [r.mismatch for r in rows.orderBy("row_no").collect()] == [False, False, True]
    out = {r.period: (r.Sales, r.Cost) for r in statements.by_period(rows, "Item", ["Sales", "Cost"]).collect()}
    assert out == {"Q1/2024": ("1000", "5"), "Q2/2024": ("2000", None)}
    assert statements.distinct_names(["x", "x", "y", "x"]) == ["x", "x_1", "y", "x_2"]


def test_mart_keeps_unmatched_quarters(spark):
    make = lambda rows: spark.createDataFrame(rows, "ticker string, quarter string, v int")
    out = merge.quarterly_mart(make([("A", "Q1/2024", 1)]), make([("A", "Q2/2024", 2)]), make([("A", "Q1/2024", 3)])).orderBy("quarter").collect()
    assert [(r["v"], r["v (balance)"], r["v (ratios)"]) for r in out] == [(1, None, 3), (None, 2, None)]


def test_streams(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [("A", t0 + datetime.timedelta(minutes=i), i, float(10 + i % 7), 1) for i in range(60)]
    schema = "ticker string, ts timestamp, seq int, price double, volume int"
    for i in range(3):
        spark.createDataFrame(rows[20 * i : 20 * i + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.tick_stream(spark, str(tmp_path / "in"), schema)
    q = live.upsert_stream(live.live_bars(stream), str(tmp_path / "out"), ["ticker", "ts"], ["volume"], str(tmp_path / "c1"), buckets=4)
    q.awaitTermination(120)
    got = PartTable(spark, str(tmp_path / "out")).read().orderBy("ts").collect()
    assert [r.volume for r in got] == [15] * 4 and got[0].open == 10.0
    assert live.alerts(spark.createDataFrame([(20.0,), (50.0,), (None,)], "rsi double")).count() == 1
