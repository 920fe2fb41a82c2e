"""A bar frame: one row per (ticker, ts), and the column builders that look along each ticker's bars.

``Frame`` holds a DataFrame and names helper columns on it, because a window
function cannot stand inside another one: ``hold`` puts a column into the frame
and gives back a reference.  All windows share one partitioning and order, so a
plan needs one shuffle and one sort however many columns it computes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def as_column(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


class Frame:
    def __init__(self, df: DataFrame, by: str = "ticker", order: str = "ts"):
        self.df, self.by, self.order, self._n = df, by, order, 0
        self.given = list(df.columns)

    def backward(self) -> "Frame":
        """The same rows read from the last bar to the first (looks ahead)."""
        return Frame(self.df, self.by, F.desc(self.order))

    # -- windows -------------------------------------------------------------
    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(self.by).orderBy(self.order)

    def back(self, n: int) -> WindowSpec:
        """The current bar and the n - 1 before it."""
        return self.w.rowsBetween(-(n - 1), 0)

    @property
    def so_far(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def whole(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def hold(self, value: Column) -> Column:
        """Put ``value`` into the frame as a helper column."""
        self._n += 1
        name = f"_h{self._n}"
        self.df = self.df.withColumn(name, value)
        return F.col(name)

    def hold_all(self, values: dict[str, Column]) -> dict[str, Column]:
        """Helper columns that are added at once, so that their windows share a step."""
        names = {}
        for name in values:
            self._n += 1
            names[name] = f"_h{self._n}"
        self.df = self.df.withColumns({names[n]: v for n, v in values.items()})
        return {n: F.col(held) for n, held in names.items()}

    def add(self, **columns: Column) -> "Frame":
        self.df = self.df.withColumns(columns)
        return self

    def select(self, *columns) -> DataFrame:
        return self.df.select(*columns)

    # -- bar-series primitives ----------------------------------------------
    def ref(self, x, n: int) -> Column:
        """Value n bars later (n > 0, looks ahead) or earlier (n < 0)."""
        return F.lag(as_column(x), -n).over(self.w) if n < 0 else F.lead(as_column(x), n).over(self.w)

    def bar(self) -> Column:
        """Ordinal of the bar from 0."""
        return F.row_number().over(self.w) - 1

    def _full(self, x, n: int, value: Column) -> Column:
        return F.when(F.count(as_column(x)).over(self.back(n)) >= n, value)

    def hhv(self, x, n: int) -> Column:
        return self._full(x, n, F.max(as_column(x)).over(self.back(n)))

    def llv(self, x, n: int) -> Column:
        return self._full(x, n, F.min(as_column(x)).over(self.back(n)))

    def sum(self, x, n: int) -> Column:
        return self._full(x, n, F.sum(as_column(x)).over(self.back(n)))

    def ma(self, x, n: int) -> Column:
        return self._full(x, n, F.avg(as_column(x)).over(self.back(n)))

    def stdev(self, x, n: int, population: bool = True) -> Column:
        return self._full(x, n, (F.stddev_pop if population else F.stddev_samp)(as_column(x)).over(self.back(n)))

    def corr(self, x, y, n: int) -> Column:
        """Correlation; null where either does not vary."""
        x, y, w = as_column(x), as_column(y), self.back(n)
        return self._full(x, n, F.try_divide(F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w)))

    def slope(self, x, n: int) -> Column:
        i = self.hold(self.bar())
        return self._full(x, n, F.regr_slope(as_column(x), i.cast("double")).over(self.back(n)))

    def linreg(self, x, n: int, ahead: int = 0) -> Column:
        """End of the least-squares line of the last n bars, or its value ``ahead`` bars on."""
        i = self.hold(self.bar()).cast("double")
        line = F.regr_intercept(as_column(x), i).over(self.back(n)) + F.regr_slope(as_column(x), i).over(self.back(n)) * (i + ahead)
        return self._full(x, n, line)

    def stderr(self, x, n: int) -> Column:
        i, x = self.hold(self.bar()).cast("double"), as_column(x)
        syy, sxy, slope = (f(x, i).over(self.back(n)) for f in (F.regr_syy, F.regr_sxy, F.regr_slope))
        return self._full(x, n, F.sqrt(F.greatest(F.lit(0.0), syy - slope * sxy) / (n - 2)))

    def cum(self, x) -> Column:
        return F.sum(as_column(x)).over(self.so_far)

    def highest(self, x) -> Column:
        return F.max(as_column(x)).over(self.so_far)

    def lowest(self, x) -> Column:
        return F.min(as_column(x)).over(self.so_far)

    def _bars_since_extreme(self, x, frame: WindowSpec, top: bool) -> Column:
        i, x = self.hold(self.bar()), as_column(x)
        if top:
            return i - F.max_by(i, F.struct(x, i)).over(frame)
        return i - F.min_by(i, F.struct(x, -i)).over(frame)

    def hhvbars(self, x, n: int) -> Column:
        return self._full(x, n, self._bars_since_extreme(x, self.back(n), True))

    def llvbars(self, x, n: int) -> Column:
        return self._full(x, n, self._bars_since_extreme(x, self.back(n), False))

    def highestbars(self, x) -> Column:
        return self._bars_since_extreme(x, self.so_far, True)

    def lowestbars(self, x) -> Column:
        return self._bars_since_extreme(x, self.so_far, False)

    def bars_since(self, cond) -> Column:
        i = self.hold(self.bar())
        return i - F.last(F.when(as_column(cond), i), ignorenulls=True).over(self.so_far)

    def value_when(self, cond, x, n: int = 1) -> Column:
        """Value at the n-th last bar where ``cond`` held; n = 0 is the next such bar (looks ahead)."""
        cond, x = as_column(cond), as_column(x)
        if n == 0:
            return F.first(F.when(cond, x), ignorenulls=True).over(self.w.rowsBetween(1, Window.unboundedFollowing))
        if n == 1:
            return F.last(F.when(cond, x), ignorenulls=True).over(self.so_far)
        hit = self.hold(F.coalesce(cond, F.lit(False)))
        hits = Window.partitionBy(self.by, hit).orderBy(self.order)
        earlier = self.hold(F.when(hit, F.struct(F.lag(x, n - 1).over(hits).alias("v"))))
        return F.last(earlier, ignorenulls=True).over(self.so_far)["v"]

    def since(self, cond, x, top: bool = True) -> Column:
        """Greatest (or least) value since ``cond`` last held; null before."""
        # Runs are numbered upwards, so the extreme of (run, value) is that of the last run, without a sort by runs.
        x, run = as_column(x), self.hold(F.sum(F.coalesce(as_column(cond), F.lit(False)).cast("int")).over(self.so_far))
        if top:
            best = F.max(F.struct(run.alias("r"), x.alias("v"))).over(self.so_far)
        else:
            best = F.min(F.struct((-run).alias("r"), x.isNull().alias("n"), x.alias("v"))).over(self.so_far)
        return F.when(run > 0, best["v"])

    def last_value(self, x) -> Column:
        """The ticker's final value on every bar (looks ahead)."""
        return F.last(as_column(x)).over(self.whole)

    def roc(self, x, n: int) -> Column:
        return 100 * (F.try_divide(as_column(x), self.ref(x, -n)) - 1)

    def momentum(self, x, n: int) -> Column:
        return as_column(x) - self.ref(x, -n)

    def percent_rank(self, x, n: int) -> Column:
        """Percentage of the n values before the current one that it exceeds; for windows of a few hundred bars."""
        x = as_column(x)
        before = F.collect_list(x).over(self.w.rowsBetween(-n, -1))
        return F.when(F.size(before) == n, 100.0 * F.size(F.filter(before, lambda v: v < x)) / n)

    def cross(self, a, b) -> Column:
        """a rises above b on this bar."""
        a, b = as_column(a), as_column(b)
        return F.coalesce((a > b) & (F.lag(a).over(self.w) <= F.lag(b).over(self.w)), F.lit(False))

    def exrem(self, a, b) -> Column:
        """Of the signals ``a`` only the first until ``b``; if both hold on a bar, a passes and then b resets."""
        a, b = (F.coalesce(as_column(x), F.lit(False)) for x in (a, b))
        group = self.hold(F.coalesce(F.sum(b.cast("int")).over(self.w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        seen = F.last(F.when(a, group), ignorenulls=True).over(self.w.rowsBetween(Window.unboundedPreceding, -1))
        return a & ~F.coalesce(seen == group, F.lit(False))

    def flip(self, a, b) -> Column:
        """True from ``a`` until ``b``; on a bar with both, a counts."""
        state = F.when(as_column(a), True).when(as_column(b), False)
        return F.coalesce(F.last(state, ignorenulls=True).over(self.so_far), F.lit(False))

    def quiet(self, signal, n: int = 3) -> Column:
        """The signal unless it was raised on one of the n bars before."""
        raised = F.coalesce(as_column(signal), F.lit(False))
        return raised & (F.coalesce(F.max(raised.cast("int")).over(self.w.rowsBetween(-n, -1)), F.lit(0)) == 0)

    def future(self, x, n: int, top: bool = True) -> Column:
        """Extreme of the next n bars (looks ahead)."""
        ahead = self.w.rowsBetween(1, n)
        return F.when(F.count(as_column(x)).over(ahead) == n, (F.max if top else F.min)(as_column(x)).over(ahead))

    def wma(self, x, n: int) -> Column:
        """Mean with weights 1 to n, the current bar's the greatest."""
        x, i = as_column(x), self.hold(self.bar())
        weighted = F.sum(x * i).over(self.back(n)) - (i - n) * F.sum(x).over(self.back(n))
        return self._full(x, n, weighted / (n * (n + 1) / 2))

    def line_between(self, start: tuple[str, int], end: tuple[str, int]) -> Column:
        """Line through two bars, each a field and a number of bars before the ticker's last; null before the first (looks ahead)."""
        left = self.hold(F.count(F.lit(1)).over(self.w.rowsBetween(0, Window.unboundedFollowing)) - 1)
        back, later = start[1], end[1]
        first, second = (self.hold(F.max(F.when(left == n, F.col(v))).over(self.whole)) for v, n in (start, end))
        return F.when(left <= back, first + (second - first) * (back - left) / (back - later))

    def gap_up(self) -> Column:
        return F.coalesce(F.col("low") > F.lag("high").over(self.w), F.lit(False))

    def gap_down(self) -> Column:
        return F.coalesce(F.col("high") < F.lag("low").over(self.w), F.lit(False))

    def run_length(self, cond) -> Column:
        """Bars in a row, up to this one, on which ``cond`` holds."""
        cond = F.coalesce(as_column(cond), F.lit(False))
        return F.coalesce(self.bars_since(~cond), self.bar() + 1)

    def true_range(self) -> Column:
        before = F.lag("close").over(self.w)
        return F.greatest("high", F.coalesce(before, F.col("high"))) - F.least("low", F.coalesce(before, F.col("low")))


#: Builders that read bars after the current one, and how far: a number of bars, "end" (up to the ticker's last bar), or
#: "next" (up to the next event of their kind).  A test tries every builder and expects these, and no other, to change
#: when later bars are taken away.  Functions of arrays (``recur``) stand here under their own names.
LOOK_AHEAD = {
    "future": "n bars", "last_value": "end", "value_when(n=0)": "next", "ref(n>0)": "n bars", "backward": "end", "line_between": "end",
    "fractals": "n bars", "pivot_rows": "next", "swing_labels": "next", "harmonics": "next", "wolfe_waves": "next", "double_extremes": "next", "impulses": "next",
    "td_points": "1 bar", "regression_channel": "end", "big_volume_levels": "end", "week_end_value": "1 bar", "session_flags": "1 bar", "transaction_speed": "1 bar", "hit_rates": "3 bars",
    "strength_and_weakness": "1 bar", "reversal_screen": "1 bar", "at_end": "end", "zigzag": "next", "swing": "next",
    "major_levels": "next", "expand(look_ahead=True)": "period",
}
