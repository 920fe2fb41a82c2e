"""Bucketed tables and the stream of averages that is stored in one."""

import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

import tests_support as plain
from tickloom.sources.parts import ConcurrentWrite, PartTable, put
from tickloom.streaming import averages, live

ROWS = "ticker string, id long, v long"


def made(spark, path, n=400, buckets=8):
    table = PartTable(spark, path)
    table.create(spark.range(n).selectExpr("concat('T', id % 10) AS ticker", "id", "id * 2 AS v"), ["ticker", "id"], ["ticker"], buckets)
    return table


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_writes_touched_buckets_only(spark, tmp_path):
    table = made(spark, str(tmp_path / "t"))
    before, files = table.manifest()["parts"], set(tmp_path.rglob("*.parquet"))
    table.upsert(spark.createDataFrame([("T3", 3, 99), ("T3", 5000, 1)], ROWS))
    after = table.manifest()["parts"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(set(tmp_path.rglob("*.parquet")) - files) == 1
    assert rows(table.read()) == sorted([("T%d" % (i % 10), i, 99 if i == 3 else i * 2) for i in range(400)] + [("T3", 5000, 1)], key=str)
    assert rows(table.read(1)) == sorted([("T%d" % (i % 10), i, i * 2) for i in range(400)], key=str)


def test_replace_reload_rollback_vacuum(spark, tmp_path):
    table = made(spark, str(tmp_path / "t"))
    table.replace_keys(spark.createDataFrame([("T4", 1, 1), (None, 2, 2)], ROWS))
    assert table.read().count() == 400 - 40 + 2 and rows(table.read().where("ticker = 'T4'")) == [("T4", 1, 1)]
    table.replace_keys(spark.createDataFrame([(None, 3, 3)], ROWS))  # null is a key here
    assert rows(table.read().where("ticker is null")) == [(None, 3, 3)]
    table.rollback(1)
    assert table.read().count() == 400 and table.versions() == [1, 2, 3, 4]
    table.reload(spark.createDataFrame([("T1", 1, 7), ("T1", 399, 8)], ROWS), F.col("id") >= 200)
    assert table.read().count() == 201 and rows(table.read().where("id >= 200")) == [("T1", 399, 8)]
    assert table.vacuum(1) == 3 and table.versions() == [5] and table.read().count() == 201


def test_failed_and_rival_writes(spark, tmp_path, monkeypatch):
    table, new = made(spark, str(tmp_path / "t")), spark.createDataFrame([("T1", 1, -1)], ROWS)
    bad = new.withColumn("v", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        table.upsert(bad)
    assert table.versions() == [1] and table.read().count() == 400
    with pytest.raises(ConcurrentWrite):
        table._publish({**table.manifest(), "version": 1})
    write, rival = PartTable._write, [True]

    def slow(self, *args):
        out = write(self, *args)
        if rival:  # another writer publishes between this one's files and its manifest
            rival.pop()
            PartTable(spark, self.path).upsert(spark.createDataFrame([("T2", 2, -2)], ROWS))
        return out

    monkeypatch.setattr(PartTable, "_write", slow)
    assert table.upsert(new) == 3
    assert rows(table.read().where("v < 0")) == [("T1", 1, -1), ("T2", 2, -2)]


def test_a_reader_always_finds_a_whole_table(spark, tmp_path):
    table, seen, stop = made(spark, str(tmp_path / "t")), [], threading.Event()

    def look():
        other = PartTable(spark, str(tmp_path / "t"))
        while not stop.is_set():
            seen.append(other.read().agg(F.count("*"), F.countDistinct("v")).first())

    reader = threading.Thread(target=look)
    reader.start()
    for i in range(4):  # each write gives all rows one new value
        table.upsert(table.read(1).withColumn("v", F.lit(i).cast("long")))
    stop.set()
    reader.join()
    assert len(seen) > 1 and {tuple(s) for s in seen} <= {(400, 400), (400, 1)}


def test_evolve_nulls_and_repeated_batches(spark, tmp_path):
    table = made(spark, str(tmp_path / "t"), 20)
    more = spark.createDataFrame([("T1", 1, 5, "x"), (None, 1, 5, "y")], f"{ROWS}, note string")
    table.upsert(more, tag=["s", 3])
    assert "note" not in table.read().columns and table.read().count() == 21
    assert table.upsert(more, tag=["s", 3]) == 2 and table.upsert(more.limit(0), tag=["s", 4]) == 3
    table.upsert(more.where("ticker is not null"), evolve=True)
    assert rows(table.read().where("note is not null").select("ticker", "note")) == [("T1", "x")]
    assert put(spark, str(tmp_path / "new"), more, ["id"], buckets=2) == 2


def bars_of(spark, closes, path):
    df = spark.createDataFrame([("A", i, c) for i, c in closes], "ticker string, s long, close double")
    df.select("ticker", F.timestamp_seconds("s").alias("ts"), "close").coalesce(1).write.mode("append").parquet(path)


def test_late_and_corrected_bars_are_replayed(spark, tmp_path):
    closes = [(i, float(10 + (i * 7) % 11)) for i in range(70)]
    wrong = [(i, 500.0 if i == 25 else None if i == 33 else c) for i, c in closes if i not in (30, 41) and i < 50]
    averages.use_rocks(spark)
    for batch in (wrong, [closes[i] for i in (41, 25, 33)], [closes[30], *closes[50:]], [(2, 1.0)]):
        bars_of(spark, batch, str(tmp_path / "in"))
        stream = averages.incremental_averages(live.tick_stream(spark, str(tmp_path / "in"), "ticker string, ts timestamp, close double", 9), 14, 50)
        live.upsert_stream(stream, str(tmp_path / "out"), ["ticker", "ts", "too_late"], ["close"], str(tmp_path / "state"), by=["ticker"]).awaitTermination(120)
    got = PartTable(spark, str(tmp_path / "out")).read().orderBy("ts").collect()
    assert [(r.close, r.ema) for r in got if r.too_late] == [(1.0, None)]
    assert np.allclose([r.ema for r in got if not r.too_late], plain.ema([c for _, c in closes], 14))


@pytest.mark.parametrize("keep", [1, 7, 100])
def test_folding_is_the_same_wherever_the_snapshot_is(keep):
    """The processor by itself, with its state in plain objects: any order of arrival inside ``keep`` gives the batch result."""
    import pandas as pd

    class Slot:
        def __init__(self):
            self.held = None

        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, x):
            self.held = x

        put = update

    draw = random.Random(keep)
    closes = [(i, draw.uniform(5, 15)) for i in range(60)]
    p, out = averages.Averages(5, keep), {}
    p.snapshot, p.recent = Slot(), Slot()
    at = 0
    while at < len(closes):
        n = draw.randint(1, max(1, keep // 2))
        part = closes[max(0, at - max(0, keep - n)) : at + n]
        draw.shuffle(part)
        for made_ in p.handleInputRows(("A",), iter([pd.DataFrame(part, columns=["us", "close"])]), None):
            assert not made_["too_late"].any()
            out.update({r.us: r.ema for r in made_.itertuples()})
        at += n
    assert np.allclose([out[i] for i in range(60)], plain.ema([c for _, c in closes], 5))
