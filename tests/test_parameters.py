"""Parameters, grids and sweeps; volume by price against a plain loop; the order of the screens' rows."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.functions import recur as k
from tickloom.operators import crosssection, parameters as pm
from tickloom.plans import filters

SMALL = "/root/testdata/sf0.001"


def bars(n, seed, ticker="A"):
    draw = np.random.default_rng(seed)
    c = 50 + np.cumsum(draw.normal(0, 1, n))
    return pd.DataFrame({"ticker": ticker, "ts": pd.date_range("2024-01-01", periods=n).date, "open": c, "high": c + draw.integers(0, 3, n), "low": c - draw.integers(0, 3, n), "close": c, "volume": draw.integers(1, 9, n)})


def test_values_are_checked():
    p = pm.Param("n", 5, 2, 20, 3)
    assert [p.at(i) for i in range(len(p))] == [2, 5, 8, 11, 14, 17, 20] and isinstance(p.check(8.0), int)
    for bad in (3, 23, -1):
        with pytest.raises(ValueError):
            p.check(bad)
    for bad in ("5", None, True):
        with pytest.raises(TypeError):
            p.check(bad)
    with pytest.raises(ValueError):
        pm.Param("n", 1, 2, 20)
    with pytest.raises(ValueError):
        pm.Param("n", 5, 6, 2)
    hot = pm.Param("hot", 0.618, 0, 1, 0.001)
    assert hot.check(0.618) == 0.618 and len(hot) == 1001
    assert pm.values_of("average_cross", fast=7) == {"fast": 7, "slow": 50}
    for bad in ({"fast": 0}, {"fast": 201}, {"none": 1}):
        with pytest.raises(ValueError):
            pm.values_of("average_cross", **bad)
    assert [len(p.narrowed(5, 16, 3)), p.narrowed(5, 16, 3).high] == [4, 14]
    with pytest.raises(ValueError):
        p.narrowed(5, 16, 2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=4))
def test_numbers_name_each_point_once(lengths):
    params = [pm.Param(f"p{i}", 1, 1, n) for i, n in enumerate(lengths)]
    seen = [tuple(pm.point(params, i).values()) for i in range(pm.points(params))]
    assert len(set(seen)) == len(seen) == np.prod(lengths) and seen == sorted(seen)


@pytest.mark.parametrize("name", pm.RULES)
def test_every_rule_sweeps(spark, name):
    params = {p.name: p for p in pm.RULES[name][1]}
    grid = {n: (p.at(1), p.at(min(5, len(p) - 1)), p.step * 2) for n, p in params.items()}
    df = spark.createDataFrame(pd.concat([bars(120, 1), bars(60, 2, "B")]))
    rows = pm.sweep(df, name, grid, chunk=3).toPandas()
    narrowed = [p.narrowed(*grid[n]) for n, p in params.items()]
    assert len(rows) == 2 * pm.points(narrowed) and rows["profit"].notna().all()
    b, first = k.Bars(bars(60, 2)), rows[rows.ticker == "B"].iloc[0]
    held = pm.RULES[name][0](b, **{n: first[n] if not params[n].whole else int(first[n]) for n in params})
    want = sum(b.c[i + 1] / b.c[i] - 1 for i in range(59) if held[i])
    assert first["profit"] == pytest.approx(want) and first["trades"] == sum(held[i] and not (i and held[i - 1]) for i in range(60))
    best = pm.best_points(pm.sweep(df, name, grid), 2).toPandas()
    assert len(best) == 4 and best[best["rank"] == 1].set_index("ticker").profit.to_dict() == pytest.approx(rows.groupby("ticker").profit.max().to_dict())
    with pytest.raises(ValueError):
        pm.sweep(df, name, {"other": (1, 2)})


def test_volume_by_price_by_a_plain_loop(spark):
    g = pd.concat([bars(70, 3), bars(3, 4, "B").assign(open=5.0, high=5.0, low=5.0, close=5.0)])
    got = {(r.ticker, r.segment, r.bin): r.volume for r in crosssection.volume_by_price(spark.createDataFrame(g), "month", 7).collect()}
    want = {}
    for (ticker, month), part in g.groupby(["ticker", pd.to_datetime(g.ts).dt.to_period("M")]):
        lo, hi = part.low.min(), part.high.max()
        for r in part.itertuples():
            for i in range(7 if hi > lo else 1):
                a, b = lo + i * (hi - lo) / 7, lo + (i + 1) * (hi - lo) / 7
                if hi == lo:
                    share = 1.0
                elif r.high > r.low:
                    share = max(0.0, min(r.high, b) - max(r.low, a)) / (r.high - r.low)
                else:
                    share = float(i == min(6, int((r.low - lo) / (hi - lo) * 7)))
                key = ticker, month.start_time.date(), i
                want[key] = want.get(key, 0.0) + r.volume * share
    want = {key: v for key, v in want.items() if v > 1e-6}
    assert got.keys() == want.keys() and all(abs(got[key] - v) < 1e-6 for key, v in want.items())
    assert sum(got.values()) == pytest.approx(g.volume.sum())


def test_screens_are_sorted_as_published(spark):
    rows = filters.early_trading(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) > 20 and {r.verdict for r in rows} == {"Buy", "Sell"}
    assert [r.price_change for r in rows] == sorted((r.price_change for r in rows), reverse=True)
    keys = [(r.industry or "", r.hhv_20 if r.hhv_20 is not None else float("-inf")) for r in filters.break_signals(spark, SMALL).collect()]
    assert keys == sorted(keys)
