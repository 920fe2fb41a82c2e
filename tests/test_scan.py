"""The grouped scan: columns, order, missing values and shared results."""

import datetime

import numpy as np
import pytest

from tickloom.functions import recur as k
from tickloom.operators.scan import scan


def test_scan_keeps_columns_order_and_nulls(spark):
    rows = [("A", datetime.date(2024, 1, d), 1.0, 2.0, 0.5, None if d == 2 else float(d), d, d % 2 == 0, "x" * d) for d in (3, 1, 2, 4)]
    df = spark.createDataFrame(rows, "ticker string, ts date, open double, high double, low double, close double, volume long, even boolean, note string")
    steps = {"m": lambda b: k.ma(b.c, 2), "inf": lambda b: b.c / 0.0, "e": lambda b: b.g["even"].to_numpy(float)}
    got = sorted(scan(df, steps).collect(), key=lambda r: r.ts)
    assert [r.m for r in got] == [None, None, None, 3.5] and all(r.inf is None for r in got) and [r.e for r in got] == [0, 1, 0, 1]
    assert [(r.note, r.close, r.volume) for r in got] == [("x", 1.0, 1), ("xx", None, 2), ("xxx", 3.0, 3), ("xxxx", 4.0, 4)]
    assert [r.ts.day for r in scan(df, steps, last=1).collect()] == [4] and scan(df, steps, last=9).count() == 4


def test_results_are_made_once_and_not_changed():
    made = []
    half = k.kept(lambda x, n: made.append(n) or x / n)
    x = np.arange(4.0)
    with k.keeping():
        assert half(x, 2) is half(x, 2) and half(x, 4)[3] == 0.75 and made == [2, 4]
        with pytest.raises(ValueError):
            half(x, 2)[0] = 1
    assert half(x, 2) is not half(x, 2)


def sorts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Sort [")


def test_since_and_exrem_need_one_sort(spark):
    from pyspark.sql import functions as F

    from tickloom.functions.frame import Frame

    rows = [("A", i, x, c, d) for i, (x, c, d) in enumerate([(5.0, False, True), (None, True, False), (3.0, False, False), (None, False, True), (4.0, False, False), (1.0, True, True), (2.0, None, False)])]
    f = Frame(spark.createDataFrame(rows, "ticker string, ts long, x double, c boolean, d boolean"))
    f.add(top=f.since("c", "x"), low=f.since("c", "x", top=False), first=f.exrem(F.col("x").isNotNull(), "d"))
    assert sorts(f.df) == 1
    got = sorted(f.df.collect(), key=lambda r: r.ts)
    assert [r.top for r in got] == [None, None, 3, 3, 4, 1, 2] and [r.low for r in got] == [None, None, 3, 3, 3, 1, 1]
    assert [r.first for r in got] == [True, False, True, False, True, False, True]


def test_runs_against_start_anew():
    import pandas as pd

    c = [5.0, 4.0, 2.0, 2.0, 3.0, 6.0, 5.0]
    rise, fall = k.runs_against(k.Bars(pd.DataFrame({x: c for x in ("open", "high", "low", "close", "volume")})))
    assert rise.tolist() == [0, 1, 3, 0, 0, 0, 1] and fall.tolist() == [0, 0, 0, 0, 1, 4, 0]
