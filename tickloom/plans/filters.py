"""Screens after the published filter formulas; thresholds of volume and value are parameters that fit the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import recur as k
from tickloom.functions.frame import Frame
from tickloom.operators import indicators as ind
from tickloom.operators.scan import scan
from tickloom.operators.vpa import said
from tickloom.plans.bars import BARS_SQL, SMOOTH_SQL, bars_eod, smooth_bars
from tickloom.plans.series_queries import framed, tidy
from tickloom.plans.sqltext import KEYS, W, full, hhv, lag, llv, ma, r, staged, total
from tickloom.plans.walks import MACD, RICH, RSI, ema, walk

QUERIES, SQL = {}, {}
LEAST_VALUE, LEAST_VOLUME, LEAST_PRICE, BODY = 1000.0, 5, 5.0, ("open", "high", "low", "close", "volume")


def query(name: str, sql: str):
    def register(make):
        QUERIES[name], SQL[name] = make, sql
        return make

    return register


def flag(x: str) -> str:
    return f"CAST(coalesce({x}, false) AS BIGINT)"


def smooth(ctes: str) -> str:
    """The same tables over prices that are means of 60 bars."""
    return ctes.replace(BARS_SQL, SMOOTH_SQL, 1)


def status(hit, yes: str, no: str, missing):
    return F.when(said(hit), yes).when(missing.isNull(), "N/A").otherwise(no)


def status_sql(hit: str, yes: str, no: str, missing: str) -> str:
    return f"CASE WHEN coalesce({hit}, false) THEN '{yes}' WHEN {missing} IS NULL THEN 'N/A' ELSE '{no}' END"


#: Money flow index of 14 bars, in steps.
_MFI = [{"tp": "(high + low + close) / 3"}, {"tp1": lag("tp")}, {"mf_up": "CASE WHEN tp1 IS NULL THEN NULL WHEN tp > tp1 THEN tp * volume ELSE 0 END", "mf_dn": "CASE WHEN tp1 IS NULL THEN NULL WHEN tp < tp1 THEN tp * volume ELSE 0 END"}, {"fu": total("mf_up", 14), "fd": total("mf_dn", 14)}, {"mfi": "100 * fu / nullif(fu + fd, 0)"}]
_SCAN = {"rsi": lambda b: k.rsi(b.c, 14), "macd": lambda b: k.macd(b.c), "signal": lambda b: k.macd_signal(b.c)}
_CTES = walk(MACD | RSI, RICH, "c")
_ROUNDED = {x: r(x) for x in ("open", "high", "low", "close")}


# -- trend score --------------------------------------------------------------------------------------
_SINCE = {f"{n}_age": f"(i - arg_{m}(i, CASE WHEN i IS NOT NULL THEN {x} END) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))" for n, m, x in (("h", "max", "row(high, i)"), ("l", "min", "row(low, -i)"))}
_SCORE = {"tk2": "close < bot AND c1 > bot1", "short": "close > m5", "medium": "close > m20", "long": "close > m60", "macd_bull": "macd > signal", "aroon": "l_age > h_age AND i >= 14", "stoch": "kk > dd", "r1": "rsi > 30 AND rsi1 < 30 AND rsi2 < 30", "m2": "mfi < 20"}


@query(
    "e10_trend_score",
    staged(
        [*_MFI, {"m5": ma("close", 5), "m20": ma("close", 20), "m60": ma("close", 60), "sd": full("stddev_pop({x}) {w}", "close", 20), "h250": hhv("high", 250), "l250": llv("low", 250), "v20": ma("volume", 20), "rsi1": lag("rsi"), "rsi2": lag("rsi", 2), "h14": hhv("high", 14), "l14": llv("low", 14), **_SINCE},
         {"top": "m20 + 2 * sd", "bot": "m20 - 2 * sd", "raw": "(close - l14) / nullif(h14 - l14, 0)"}, {"top1": lag("top"), "bot1": lag("bot"), "kk": ma("raw", 3)}, {"dd": ma("kk", 3)}],
        KEYS | {"score": " + ".join(flag(x) for x in _SCORE.values()), "high_52w": r("h250"), "low_52w": r("l250"), **_ROUNDED, "volume": "volume",
                "band": "CASE WHEN coalesce(close > top AND c1 < top1, false) THEN 'Peak' WHEN coalesce(close < bot AND c1 > bot1, false) THEN 'Trough' WHEN m20 IS NULL THEN 'N/A' ELSE 'Neutral' END", "short_ma": status_sql("close > m5", "Bullish", "Bearish", "m5"), "medium_ma": status_sql("close > m20", "Bullish", "Bearish", "m20"), "long_ma": status_sql("close > m60", "Bullish", "Bearish", "m60"),
                "macd_status": status_sql("macd > signal", "Bullish", "Bearish", "macd"), "aroon_status": status_sql(_SCORE["aroon"], "Bullish", "Bearish", "rsi"), "stoch_status": status_sql("kk > dd", "Bullish", "Bearish", "kk"), "rsi_status": "CASE WHEN coalesce(rsi > 30 AND rsi1 < 30 AND rsi2 < 30, false) THEN 'Increased' WHEN coalesce(rsi < 70 AND rsi1 > 70 AND rsi2 > 70, false) THEN 'Decreased' WHEN rsi IS NULL THEN 'N/A' ELSE 'Neutral' END",
                "mfi_status": "CASE WHEN mfi > 80 THEN 'Saturated buying' WHEN mfi < 20 THEN 'Saturated Selling' WHEN mfi IS NULL THEN 'N/A' ELSE 'Neutral' END"},
        source="w", ctes=_CTES, recursive=True, tail=f"WHERE v20 * m20 > {LEAST_VALUE}",
    ),
)
def trend_score(spark, d, least: float = LEAST_VALUE):
    """Nine flags of trend and their sum, of shares whose mean value traded is over ``least``."""
    f = Frame(scan(bars_eod(spark, d), _SCAN | {"kk": lambda b: k.stoch_share(b), "dd": lambda b: k.ma(k.stoch_share(b), 3)}))
    c, i = F.col("close"), f.hold(f.bar())
    m = f.hold_all({"m5": f.ma("close", 5), "m20": f.ma("close", 20), "m60": f.ma("close", 60), "sd": f.stdev("close", 20), "high_52w": f.hhv("high", 250), "low_52w": f.llv("low", 250), "v20": f.ma("volume", 20), "mfi": ind.mfi(f, 14), "rsi1": F.lag("rsi", 1).over(f.w), "rsi2": F.lag("rsi", 2).over(f.w), "c1": F.lag(c).over(f.w),
                    "h_at": F.max_by(i, F.struct("high", i)).over(f.back(14)), "l_at": F.min_by(i, F.struct(F.col("low"), -i)).over(f.back(14))})
    top, bot = m["m20"] + 2 * m["sd"], m["m20"] - 2 * m["sd"]
    was = f.hold_all({"top": F.lag(top).over(f.w), "bot": F.lag(bot).over(f.w)})
    rsi, peak, trough = F.col("rsi"), (c > top) & (m["c1"] < was["top"]), (c < bot) & (m["c1"] > was["bot"])
    aroon, rises = (m["h_at"] > m["l_at"]) & (i >= 13), (rsi > 30) & (m["rsi1"] < 30) & (m["rsi2"] < 30)
    flags = [trough, c > m["m5"], c > m["m20"], c > m["m60"], F.col("macd") > F.col("signal"), aroon, F.col("kk") > F.col("dd"), rises, m["mfi"] < 20]
    columns = {
        "score": sum((said(x).cast("long") for x in flags), F.lit(0).cast("long")), "high_52w": m["high_52w"], "low_52w": m["low_52w"], "band": F.when(said(peak), "Peak").when(said(trough), "Trough").when(m["m20"].isNull(), "N/A").otherwise("Neutral"),
        **{f"{n}_ma": status(c > m[x], "Bullish", "Bearish", m[x]) for n, x in (("short", "m5"), ("medium", "m20"), ("long", "m60"))}, "macd_status": status(F.col("macd") > F.col("signal"), "Bullish", "Bearish", F.col("macd")), "aroon_status": status(aroon, "Bullish", "Bearish", rsi), "stoch_status": status(F.col("kk") > F.col("dd"), "Bullish", "Bearish", F.col("kk")),
        "rsi_status": F.when(said(rises), "Increased").when(said((rsi < 70) & (m["rsi1"] > 70) & (m["rsi2"] > 70)), "Decreased").when(rsi.isNull(), "N/A").otherwise("Neutral"), "mfi_status": F.when(m["mfi"] > 80, "Saturated buying").when(m["mfi"] < 20, "Saturated Selling").when(m["mfi"].isNull(), "N/A").otherwise("Neutral"),
    }
    return tidy(f.df.where(m["v20"] * m["m20"] > least).select("ticker", "ts", *BODY, *[x.alias(n) for n, x in columns.items()]))


# -- band trend ---------------------------------------------------------------------------------------
_HORIZONS = ((5, 15, 10), (10, 20, 20), (15, 30, 30), (20, 50, 40))


@query(
    "e11_bollinger_trend",
    staged([{f"m{n}": ma("close", n) for _, n, _ in _HORIZONS} | {f"s{n}": full("stddev_pop({x}) {w}", "close", n) for _, n, _ in _HORIZONS} | {"v5": ma("volume", 5), "volume1": lag("volume")},
            {"tf": " + ".join(f"{weight} * CASE WHEN e{fast} > m{n} + 0.5 * s{n} THEN 1 WHEN e{fast} < m{n} + 0.5 * s{n} AND e{fast} > m{n} - 0.5 * s{n} THEN 0 ELSE -1 END" for fast, n, weight in _HORIZONS)}],
           KEYS | {"rank": "CASE WHEN tf >= 50 THEN 3 WHEN tf < 50 AND tf > 25 THEN 2 WHEN tf < 25 AND tf >= 0 THEN 1 WHEN tf < 0 AND tf >= -25 THEN -1 WHEN tf < -25 AND tf >= -50 THEN -2 WHEN tf < -50 THEN -3 ELSE 0 END", "close": r("close"), "price_change": r("100 * (close / c1 - 1)"), "volume": "volume", "volume_change": r("100 * (volume / volume1 - 1)"), "volume_ma5": r("v5")},
           source="w", ctes=walk({f"e{n}": ema("close", n) for n, _, _ in _HORIZONS}), recursive=True, tail=f"WHERE volume >= v5 * 1.15 AND volume >= {LEAST_VOLUME}"),
)
def bollinger_trend(spark, d, least: int = LEAST_VOLUME):
    """Rank of four averages against half-deviation bands of four horizons, weighted 10 to 40."""
    f = Frame(scan(bars_eod(spark, d), {f"e{n}": (lambda b, n=n: k.ema(b.c, n)) for n, _, _ in _HORIZONS}))
    m = f.hold_all({f"m{n}": f.ma("close", n) for _, n, _ in _HORIZONS} | {f"s{n}": f.stdev("close", n) for _, n, _ in _HORIZONS} | {"v5": f.ma("volume", 5), "price_change": f.roc("close", 1), "volume_change": f.roc("volume", 1)})
    tf = F.lit(0)
    for fast, n, weight in _HORIZONS:
        e, top, bot = F.col(f"e{fast}"), m[f"m{n}"] + 0.5 * m[f"s{n}"], m[f"m{n}"] - 0.5 * m[f"s{n}"]
        tf = tf + weight * F.when(e > top, 1).when((e < top) & (e > bot), 0).otherwise(-1)
    rank = F.when(tf >= 50, 3).when((tf < 50) & (tf > 25), 2).when((tf < 25) & (tf >= 0), 1).when((tf < 0) & (tf >= -25), -1).when((tf < -25) & (tf >= -50), -2).when(tf < -50, -3).otherwise(0)
    kept = f.df.where((F.col("volume") >= m["v5"] * 1.15) & (F.col("volume") >= least))
    return tidy(kept.select("ticker", "ts", rank.alias("rank"), "close", m["price_change"].alias("price_change"), "volume", m["volume_change"].alias("volume_change"), m["v5"].alias("volume_ma5")))


# -- early trading ------------------------------------------------------------------------------------
@query(
    "e12_early_trading",
    staged([*_MFI, {"m21": ma("close", 21), "v5": ma("volume", 5), "macd1": lag("macd"), "mfi1": lag("mfi"), "volume1": lag("volume"), "h10": hhv("c1", 10), "l10": llv("c1", 10), "h21": hhv("c1", 21), "l21": llv("c1", 21), "mm": ma("close", 15), "sd": full("stddev_pop({x}) {w}", "close", 15), "change": "100 * (close / c1 - 1)"},
            {"top": "mm + 2 * sd"}, {"top1": lag("top")},
            {"shared": f"coalesce(h10 < 1.05 * l10 AND volume > {LEAST_VOLUME} AND volume > v5 * 1.15, false)"},
            {"buy": f"shared AND coalesce(close > m21 AND macd > signal AND macd > macd1 AND change > 1 AND l21 * 1.15 > close AND mfi > mfi1 AND top > top1 AND close > {LEAST_PRICE}, false)", "sell": "shared AND coalesce(close < m21 AND macd < signal AND macd < macd1 AND change < -1 AND h21 * 0.85 < close AND mfi < mfi1 AND top < top1, false)"}],
           KEYS | {"previous_price": r("c1"), "price": r("close"), "price_change": r("change"), "previous_volume": "volume1", "volume": "volume", "volume_change": r("100 * (volume / volume1 - 1)"), "volume_ma5": r("v5"), "volume_over_ma5": r("(volume - v5) * 100 / v5"), "verdict": "CASE WHEN buy THEN 'Buy' ELSE 'Sell' END"},
           source="w", ctes=smooth(walk(MACD)), recursive=True, tail="WHERE buy OR sell"),
)
def early_trading(spark, d):
    return tidy(early_trades(smooth_bars(spark, d))).orderBy(F.desc("price_change"), "ticker")


def early_trades(bars, span: float = 1.05, above: float = 1.15, below: float = 0.85, rise: float = 15.0, least: int = LEAST_VOLUME, least_price: float = LEAST_PRICE):
    """Nine conditions for buying, eight for selling; the greatest day change comes first.

    The 10 bars before lie within ``span`` times their lowest close; the close is
    under ``above`` times the lowest of 21 (to buy), over ``below`` times the
    highest (to sell).
    """
    f = Frame(scan(bars, {n: _SCAN[n] for n in ("macd", "signal")}))
    c, v = F.col("close"), F.col("volume")
    before = f.hold_all({"c1": F.lag(c).over(f.w), "mfi": ind.mfi(f, 14), "mm": f.ma("close", 15), "sd": f.stdev("close", 15), "m21": f.ma("close", 21), "v5": f.ma("volume", 5), "change": f.roc("close", 1), "volume_change": f.roc("volume", 1), "v1": F.lag(v).over(f.w), "macd1": F.lag("macd").over(f.w)})
    top = before["mm"] + 2 * before["sd"]
    m = before | f.hold_all({"h10": f.hhv(before["c1"], 10), "l10": f.llv(before["c1"], 10), "h21": f.hhv(before["c1"], 21), "l21": f.llv(before["c1"], 21), "mfi1": F.lag(before["mfi"]).over(f.w), "top1": F.lag(top).over(f.w)})
    shared = (m["h10"] < span * m["l10"]) & (v > least) & (v > m["v5"] * (1 + rise / 100))
    buy = shared & (c > m["m21"]) & (F.col("macd") > F.col("signal")) & (F.col("macd") > m["macd1"]) & (m["change"] > 1) & (m["l21"] * above > c) & (m["mfi"] > m["mfi1"]) & (top > m["top1"]) & (c > least_price)
    sell = shared & (c < m["m21"]) & (F.col("macd") < F.col("signal")) & (F.col("macd") < m["macd1"]) & (m["change"] < -1) & (m["h21"] * below < c) & (m["mfi"] < m["mfi1"]) & (top < m["top1"])
    f.add(buy_=said(buy), sell_=said(sell))
    rows = f.df.where("buy_ or sell_").select("ticker", "ts", m["c1"].alias("previous_price"), c.alias("price"), m["change"].alias("price_change"), m["v1"].alias("previous_volume"), "volume", m["volume_change"].alias("volume_change"), m["v5"].alias("volume_ma5"), ((v - m["v5"]) * 100 / m["v5"]).alias("volume_over_ma5"), F.when(F.col("buy_"), "Buy").otherwise("Sell").alias("verdict"))
    return rows.orderBy(F.desc("price_change"), "ticker")


# -- reversal -----------------------------------------------------------------------------------------
_AVG = {"av": "(high + low + close) / 3"}
_R = {
    "down": "a1 < a2 AND a2 < a3 AND a1 < a4 AND c1 <= o1 AND c2 <= o2", "up": "a1 > a2 AND a2 > a3 AND a1 > a4 AND c1 >= o1 AND c2 >= o2",
    "hammer": "(open = high AND close < open AND close - low >= 2 * (open - close)) OR (close = high AND close > open AND open - low >= 2 * (close - open))",
}


@query(
    "e13_reversal_screen",
    staged([_AVG | {"dv": "(open + high + low + close) / 4 * volume"}, {f"a{i}": lag("av", i) for i in range(1, 5)} | {"c2": lag("close", 2), "o1": lag("open"), "o2": lag("open", 2), "mdv": ma("dv", 20), "later": f"100 * (lead(close) {W} / close - 1)"},
            {"buy": f"coalesce({_R['down']} AND (open = close OR close > open OR {_R['hammer']}) AND mdv > {LEAST_VALUE} AND rsi < 35, false)", "sell": f"coalesce({_R['up']} AND (open = close OR close < open OR {_R['hammer']}) AND mdv > {LEAST_VALUE} AND rsi > 65, false)"}],
           KEYS | {"rsi": r("rsi"), "value": r("dv", 2), "close": r("close"), "trade_price": r("CASE WHEN buy THEN close * 1.05 ELSE close * 0.95 END"), "next_change": r("later"), "verdict": "CASE WHEN buy THEN 'Buy' ELSE 'Sell' END"},
           source="w", ctes=walk(RSI, RICH, "c"), recursive=True, tail="WHERE buy OR sell"),
)
def reversal_screen(spark, d, most_rsi: float = 35, least_rsi: float = 65, least: float = LEAST_VALUE):
    """Candles that may turn a fall (or rise) of three means; ``next_change`` looks one bar ahead, as a report on the past does."""
    f = Frame(scan(bars_eod(spark, d), {"rsi": _SCAN["rsi"]}))
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    av, dv = (h + l + c) / 3, (o + h + l + c) / 4 * F.col("volume")
    m = f.hold_all({f"a{i}": F.lag(av, i).over(f.w) for i in range(1, 5)} | {f"{n}{i}": F.lag(x, i).over(f.w) for n, x in (("c", c), ("o", o)) for i in (1, 2)} | {"mdv": f.ma(dv, 20), "later": 100 * (f.ref("close", 1) / c - 1)})
    fell = (m["a1"] < m["a2"]) & (m["a2"] < m["a3"]) & (m["a1"] < m["a4"]) & (m["c1"] <= m["o1"]) & (m["c2"] <= m["o2"])
    rose = (m["a1"] > m["a2"]) & (m["a2"] > m["a3"]) & (m["a1"] > m["a4"]) & (m["c1"] >= m["o1"]) & (m["c2"] >= m["o2"])
    hammer = ((o == h) & (c < o) & (c - l >= 2 * (o - c))) | ((c == h) & (c > o) & (o - l >= 2 * (c - o)))
    f.add(buy_=said(fell & ((o == c) | (c > o) | hammer) & (m["mdv"] > least) & (F.col("rsi") < most_rsi)), sell_=said(rose & ((o == c) | (c < o) | hammer) & (m["mdv"] > least) & (F.col("rsi") > least_rsi)))
    rows = f.df.where("buy_ or sell_").select("ticker", "ts", "rsi", dv.alias("value"), "close", F.when(F.col("buy_"), c * 1.05).otherwise(c * 0.95).alias("trade_price"), m["later"].alias("next_change"), F.when(F.col("buy_"), "Buy").otherwise("Sell").alias("verdict"))
    return tidy(rows, value=2).orderBy("rsi", "ticker", "ts")


# -- explosive moves, volume spikes, breaks, flat clouds ----------------------------------------------
@query(
    "e14_contraction",
    staged([{f"w{n}": f"({hhv('high', n)}) - ({llv('low', n)})" for n in (2, 3, 4)} | {"h1": lag("high"), "l1": lag("low"), "c1": lag("close"), "v5": ma("volume", 5)}, {"a": lag("w2", 1), "b": lag("w3", 2), "c": lag("w4", 3)}],
           KEYS | {"price": r("close"), "previous_price": r("c1"), "change": r("100 * (close / c1 - 1)"), "volume": "volume", "volume_ma5": r("v5")}, tail=f"WHERE high - low < a AND high - low < b AND high - low < c AND high < h1 AND low > l1 AND volume > v5 * 1.05 AND volume > {LEAST_VOLUME}"),
)
def contraction(spark, d, least: int = LEAST_VOLUME):
    """Inside bars narrower than the ranges of the 2, 3 and 4 bars that ended 1, 2 and 3 bars ago, on rising volume."""
    f = framed(spark, d)
    span = f.hold_all({n: f.hhv("high", n) - f.llv("low", n) for n in (2, 3, 4)})
    m = f.hold_all({f"r{n}": F.lag(span[n], n - 1).over(f.w) for n in (2, 3, 4)} | {"h1": F.lag("high").over(f.w), "l1": F.lag("low").over(f.w), "c1": F.lag("close").over(f.w), "v5": f.ma("volume", 5), "change": f.roc("close", 1)})
    now = F.col("high") - F.col("low")
    kept = f.df.where((now < m["r2"]) & (now < m["r3"]) & (now < m["r4"]) & (F.col("high") < m["h1"]) & (F.col("low") > m["l1"]) & (F.col("volume") > m["v5"] * 1.05) & (F.col("volume") > least))
    return tidy(kept.select("ticker", "ts", F.col("close").alias("price"), m["c1"].alias("previous_price"), m["change"].alias("change"), "volume", m["v5"].alias("volume_ma5")))


_SPIKE = staged([{"v30": full("CAST(sum({x}) {w} AS DOUBLE) / 30", "volume", 30), "m30": ma("close", 30), "c1": lag("close"), "vol5": lag("volume", 5), "vol10": lag("volume", 10)}],
                KEYS | {"change": r("(close - c1) / c1 * 100"), "deal_value": r("close * volume", 2), "price": r("close"), "volume": "volume"}, tail=f"WHERE volume >= 1.3 * v30 AND close >= 1 AND close * volume >= {LEAST_VALUE} AND close > 1.02 * c1 AND close >= m30 AND v30 >= {LEAST_VOLUME} AND close >= open AND vol5 > {LEAST_VOLUME} AND vol10 > {LEAST_VOLUME}")


@query("e20_volume_spike", _SPIKE)
def volume_spike(spark, d, least: int = LEAST_VOLUME, least_value: float = LEAST_VALUE):
    """Nine conditions on volume, value and price."""
    f = framed(spark, d)
    c, v = F.col("close"), F.col("volume")
    m = f.hold_all({"v30": f.ma("volume", 30), "m30": f.ma("close", 30), "c1": F.lag(c).over(f.w), "v5": F.lag(v, 5).over(f.w), "v10": F.lag(v, 10).over(f.w)})
    kept = f.df.where((v >= 1.3 * m["v30"]) & (c >= 1) & (c * v >= least_value) & (c > 1.02 * m["c1"]) & (c >= m["m30"]) & (m["v30"] >= least) & (c >= F.col("open")) & (m["v5"] > least) & (m["v10"] > least))
    return tidy(kept.select("ticker", "ts", ((c - m["c1"]) / m["c1"] * 100).alias("change"), (c * v).alias("deal_value"), c.alias("price"), "volume"), deal_value=2)


@query("e20_summary", f"SELECT count(*) AS n, sum(volume) AS volume, {r('avg(change)', 3)} AS mean_change, min(price) AS least_price, max(price) AS greatest_price FROM ({_SPIKE})")
def spike_summary(spark, d):
    """The footer of the volume spikes: their count, and total, mean and extremes of columns."""
    s = volume_spike(spark, d)
    return tidy(s.agg(F.count("*").alias("n"), F.sum("volume").alias("volume"), F.avg("change").alias("mean_change"), F.min("price").alias("least_price"), F.max("price").alias("greatest_price")), mean_change=3)


_SPANS = (20, 50, 100, 200)


@query(
    "e22_break_signals",
    staged([{f"h{n}": hhv("high", n) for n in _SPANS} | {f"l{n}": llv("high", n) for n in _SPANS} | {f"m{n}": ma("close", n) for n in _SPANS} | {"c1": lag("close"), "v5": ma("volume", 5)}],
           KEYS | {"industry": "n_name", "c_1": r("(close - c1) * 100 / c1")} | {f"hhv_{n}": r(f"(close - h{n}) * 100 / h{n}") for n in _SPANS} | {f"llv_{n}": r(f"(close - l{n}) * 100 / l{n}") for n in _SPANS} | {f"ma_{n}": r(f"close - m{n}") for n in _SPANS},
           tail=f"LEFT JOIN (SELECT 'S' || s_suppkey AS t, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey) ON t = ticker WHERE v5 >= {LEAST_VOLUME} AND close >= 2.5"),
)
def break_signals(spark, d, least: int = LEAST_VOLUME, least_price: float = 2.5):
    """Distance from the extremes of the high (both of them, as published) and from the averages, with the industry; sorted by industry and then by distance from the 20-bar high."""
    from tickloom.plans.bars import dimension

    c = F.col("close")
    steps = {"c1": lambda b: k.ref(b.c, -1), "v5": lambda b: k.ma(b.v, 5)}
    for n in _SPANS:
        steps |= {f"h{n}": lambda b, n=n: k.hhv(b.h, n), f"l{n}": lambda b, n=n: k.llv(b.h, n), f"m{n}": lambda b, n=n: k.ma(b.c, n)}
    scanned = scan(bars_eod(spark, d).select("ticker", "ts", "high", "close", "volume"), steps, keep=("ticker", "ts", "close"))
    m, kept = {n: F.col(n) for n in steps}, scanned.where((F.col("v5") >= least) & (c >= least_price))
    share = lambda x: ((c - x) * 100 / x)
    rows = kept.select("ticker", "ts", share(m["c1"]).alias("c_1"), *[share(m[f"h{n}"]).alias(f"hhv_{n}") for n in _SPANS], *[share(m[f"l{n}"]).alias(f"llv_{n}") for n in _SPANS], *[(c - m[f"m{n}"]).alias(f"ma_{n}") for n in _SPANS])
    rows = rows.repartition("ticker")  # the sort below first samples what it sorts: it takes this shuffle's files, and bars are scanned once
    named = tidy(rows).join(dimension(spark, d).select("ticker", "industry"), "ticker", "left")
    return named.orderBy("industry", "hhv_20")


_CL, _BL = f"(({hhv('high', 9)}) + ({llv('low', 9)})) / 2", f"(({hhv('high', 26)}) + ({llv('low', 26)})) / 2"


@query(
    "e23_strong_up_trend",
    staged([{"cl": _CL, "bl": _BL, "h5": hhv("high", 5), "l5": llv("low", 5), "v15": ma("volume", 15)}, {"tl": "abs((cl - bl) / cl)", "raw": "(close - l5) / nullif(h5 - l5, 0)"}, {"kk": "100 * " + f"({ma('raw', 3)})"}, {"dd": ma("kk", 3)} | {f"t{i}": lag("tl", i) for i in range(1, 5)} | {f"{x}{i}": lag(x, i) for x in ("cl", "bl") for i in (1, 2, 3)}],
           KEYS | {"close": r("close"), "volume": "volume", "mean_volume": r("v15"), "rsi": r("rsi"), "stoch_d": r("dd")}, source="w", ctes=smooth(walk(RSI, RICH, "c")), recursive=True,
           tail="WHERE " + " AND ".join(["tl < 0.01", *(f"t{i} < 0.01" for i in range(1, 5)), *(f"{x} > {x}1 AND {x}1 > {x}2 AND {x}2 > {x}3" for x in ("cl", "bl"))])),
)
def strong_up_trend(spark, d):
    return tidy(rising_lines(smooth_bars(spark, d)))


def rising_lines(bars, within: float = 0.01):
    """Both middle lines rising for three bars and within ``within`` of each other for five."""
    f = Frame(scan(bars, {"rsi": _SCAN["rsi"], "stoch_d": lambda b: k.stoch_d(b, 5, 3, 3)}))
    line = f.hold_all({"cl": (f.hhv("high", 9) + f.llv("low", 9)) / 2, "bl": (f.hhv("high", 26) + f.llv("low", 26)) / 2, "mean_volume": f.ma("volume", 15)})
    apart = F.abs((line["cl"] - line["bl"]) / line["cl"])
    m = f.hold_all({f"t{i}": F.lag(apart, i).over(f.w) for i in range(1, 5)} | {f"{x}{i}": F.lag(line[x], i).over(f.w) for x in ("cl", "bl") for i in (1, 2, 3)})
    kept = apart < within
    for i in range(1, 5):
        kept = kept & (m[f"t{i}"] < within)
    for x in ("cl", "bl"):
        kept = kept & (line[x] > m[f"{x}1"]) & (m[f"{x}1"] > m[f"{x}2"]) & (m[f"{x}2"] > m[f"{x}3"])
    return f.df.where(kept).select("ticker", "ts", "close", "volume", line["mean_volume"].alias("mean_volume"), "rsi", "stoch_d")


@query("p_mean_liquidity", staged([{"v20": ma("volume", 20), "cv20": ma("close * volume", 20)}], KEYS | {"mean_volume": r("v20"), "mean_value": r("cv20", 2)}, tail="WHERE v20 >= 30 AND cv20 >= 40000"))
def mean_liquidity(spark, d, least: float = 30, least_value: float = 40_000):
    """Bars of shares whose mean volume and mean value traded reach their bounds."""
    f = framed(spark, d)
    m = f.hold_all({"mean_volume": f.ma("volume", 20), "mean_value": f.ma(F.col("close") * F.col("volume"), 20)})
    return tidy(f.df.where((m["mean_volume"] >= least) & (m["mean_value"] >= least_value)).select("ticker", "ts", *[x.alias(n) for n, x in m.items()]), mean_value=2)
