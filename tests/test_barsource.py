"""Bar files by ranges of records, as a batch, a stream and a sink."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.sources import barfiles, barsource
from tickloom.sources.parts import PartTable
from tickloom.streaming import live


def file_of(path, days, close=1.0):
    rows = np.zeros(len(days), barfiles.RECORD)
    rows["d"], rows["close"], rows["volume"], rows["t"] = days, close, 3.7, 93015
    with open(path, "ab") as f:
        f.write(rows.tobytes())


def test_ranges_cut_large_files_and_join_small_ones():
    parts = barsource.dealt([("a", 0, 10), ("b", 5, 1), ("c", 0, 2), ("d", 0, 0)], 4 * barfiles.RECORD.itemsize)
    assert [p.pieces for p in parts] == [[("a", 0, 4)], [("a", 4, 4)], [("a", 8, 2), ("b", 5, 1), ("c", 0, 1)], [("c", 1, 1)]]


@pytest.mark.parametrize("split", [32, 100, 1 << 20])
def test_read_equals_whole_files(spark, tmp_path, split):
    days = [20240101 + i for i in range(31)] + [20240231, 19800101, 20240105]
    for kind, name in (("stock", "abc"), ("index", "abc"), ("stock", " x y")):
        (tmp_path / kind).mkdir(exist_ok=True)
        file_of(tmp_path / kind / f"{name}.dat", days, len(name) + 0.005)
    (tmp_path / "stock" / "cut.dat").write_bytes(b"x" * 40)
    (tmp_path / "stock" / "empty.dat").write_bytes(b"")
    (tmp_path / "stock" / "note.txt").write_text("x" * 64)
    one, two = barfiles.read_bar_files(spark, str(tmp_path)), barsource.read_bars(spark, str(tmp_path), split_bytes=split)
    assert sorted(one.collect()) == sorted(two.collect()) and two.where("asset_class = 'stock'").count() == 62
    assert barsource.read_bars(spark, str(tmp_path), since="2024-01-20", split_bytes=split).count() == 36
    assert barsource.read_bars(spark, f"file://{tmp_path}", intraday=True).agg(F.max("ts")).first()[0] == datetime.datetime(2024, 1, 31, 9, 30, 15)


def test_written_and_read_again(spark, tmp_path):
    bars = spark.range(300).selectExpr("concat('T', id % 7) AS ticker", "date_add(date '2024-01-01', cast(id AS int)) AS ts", *[f"cast(id AS double) + {i} AS {c}" for i, c in enumerate(("open", "high", "low", "close"))], "id AS volume")
    for _ in range(2):  # a second time replaces the files
        barsource.write_bars(bars, str(tmp_path / "out"), "fund")
    got = barsource.read_bars(spark, str(tmp_path / "out"))
    assert sorted(got.select(*bars.columns).collect()) == sorted(bars.collect())
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"fund"} and got.select("asset_class").distinct().collect() == [("fund",)]
    bad = bars.withColumn("close", F.when(F.col("volume") < 200, F.col("close")).otherwise(F.raise_error(F.lit("no")).cast("double")))
    with pytest.raises(Exception):
        barsource.write_bars(bad, str(tmp_path / "out"), "bad")
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"fund"}


def test_a_stream_takes_what_files_gain(spark, tmp_path):
    folder = tmp_path / "in" / "stock"
    folder.mkdir(parents=True)

    def run():
        stream = barsource.bar_stream(spark, str(tmp_path / "in"))
        live.upsert_stream(stream, str(tmp_path / "out"), ["ticker", "ts"], ["record"], str(tmp_path / "state"), buckets=2).awaitTermination(120)
        return {(r.ticker, r.ts.day): r.close for r in PartTable(spark, str(tmp_path / "out")).read().collect()}

    file_of(folder / "a.dat", [20240101, 20240102, 20240102], [1, 2, 3])
    assert run() == {("A", 1): 1, ("A", 2): 3}
    file_of(folder / "a.dat", [20240102, 20240103], [4, 5])
    file_of(folder / "b.dat", [20240101], 9)
    assert run() == {("A", 1): 1, ("A", 2): 4, ("A", 3): 5, ("B", 1): 9}


def test_files_that_are_alone_are_read_whole(spark, tmp_path):
    """Their bars meet no others, so they are not shuffled; files of one ticker, in any letter case or folder, are, and large ones."""
    for folder, name, days in (("a/stock", "abc", [20240103, 20240101, 20240103, 20240231]), ("a/stock", "x", [20240101]), ("b/stock", "X ", [20240101, 20240102]), ("a/fund", "x", [20240105]), ("a/fund", "é", [20240101]), ("a/fund", "long", list(range(20240101, 20240132)))):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        file_of(tmp_path / folder / f"{name}.dat", days, len(days))
    options = {"path": str(tmp_path), "splitbytes": 8 * barfiles.RECORD.itemsize}
    of = {files: {"/".join(p.split("/")[-3:]) for part in barsource.BarReader(options | {"files": files}).partitions() for p, _, _ in part.pieces} for files in ("alone", "shared", "all")}
    assert of["alone"] == {"a/stock/abc.dat", "a/fund/x.dat"} and of["alone"] | of["shared"] == of["all"] and not of["alone"] & of["shared"]
    reader = barsource.BarReader(options | {"files": "alone"})
    kept = {(r["path"], r["record"], r["d"]) for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()}
    assert kept == {("fund/x.dat", 0, 20240105), ("stock/abc.dat", 1, 20240101), ("stock/abc.dat", 2, 20240103), ("stock/abc.dat", 3, 20240231)}
    got = barsource.read_bars(spark, str(tmp_path), split_bytes=options["splitbytes"])
    assert got.count() == 2 + 2 + 1 + 1 + 31 and got.groupBy("asset_class", "ticker", "ts").count().where("count > 1").count() == 0


def test_times_are_those_of_the_session(spark, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Ho_Chi_Minh")
    try:
        bars = spark.sql("SELECT t AS ticker, timestamp'1999-12-31 23:59:58' + make_dt_interval(0, 0, 0, id) AS ts, 1D AS open, 2D AS high, CAST(NULL AS DOUBLE) AS low, 1D AS close, 5 AS volume FROM range(4), (SELECT explode(array('a', 'b')) AS t)")
        barsource.write_bars(bars, str(tmp_path / "out"))
        rows = np.fromfile(tmp_path / "out" / "stock" / "b.dat", barfiles.RECORD)
        assert rows["d"].tolist() == [19991231] * 2 + [20000101] * 2 and rows["t"].tolist() == [235958, 235959, 0, 1] and np.isnan(rows["low"]).all()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
