"""Window building blocks over rows of one ticker in date order.

A rolling value is null until its frame holds ``n`` values that are not null. Comparisons with null are false (``truth``).
Frames that look at a whole ticker (percentiles, scales) see later rows too, as the measures built on them are defined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY, TIME = "ticker", "date"


def ordered(key: str = KEY, time: str = TIME) -> WindowSpec:
    return Window.partitionBy(key).orderBy(time)


def frame(n: int) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return ordered().rowsBetween(-(n - 1), 0)


def running() -> WindowSpec:
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def ahead(n: int) -> WindowSpec:
    """The current row and up to n after it."""
    return ordered().rowsBetween(0, n)


def before(n: int) -> WindowSpec:
    """All rows up to n rows before the current one."""
    return ordered().rowsBetween(Window.unboundedPreceding, -n)


def known(x: Column | str, n: int) -> Column:
    """Whether all of the last n rows are known: a difference of running counts, so its cost does not grow with n."""
    return F.count(_c(x)).over(running()) - F.count(_c(x)).over(before(n)) == n


def prefix_total(x: Column | str, n: int) -> Column:
    """Sum over the last n rows as a difference of running sums; for values of like size, as the difference keeps the rounding of all that came before."""
    return F.sum(_c(x)).over(running()) - F.coalesce(F.sum(_c(x)).over(before(n)), F.lit(0.0))


def whole() -> WindowSpec:
    return Window.partitionBy(KEY)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rolling(aggregate: Callable[[Column], Column], x: Column | str, n: int) -> Column:
    """``aggregate`` over n rows, null unless all n are known."""
    return F.when(known(x, n), aggregate(_c(x)).over(frame(n)))


def mean(x, n: int) -> Column:
    return rolling(F.avg, x, n)


def total(x, n: int) -> Column:
    return rolling(F.sum, x, n)


def low(x, n: int) -> Column:
    return rolling(F.min, x, n)


def high(x, n: int) -> Column:
    return rolling(F.max, x, n)


def deviation(x, n: int) -> Column:
    """Sample standard deviation."""
    return rolling(F.stddev_samp, x, n)


def lag(x, n: int = 1) -> Column:
    """n rows earlier; a negative n looks ahead."""
    return F.lag(_c(x), n).over(ordered()) if n >= 0 else F.lead(_c(x), -n).over(ordered())


def change(x, n: int = 1) -> Column:
    return _c(x) - lag(x, n)


def truth(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def zscore(x, n: int) -> Column:
    centre = F.when(known(x, n), prefix_total(_c(x).cast("double"), n) / n)
    return F.try_divide(_c(x) - centre, deviation(x, n))


def rolling_zscore(x, window: int = 250, short: int = 120) -> Column:
    """z-score over ``window`` rows, over ``short`` rows where the ticker has no more than ``window``."""
    few = F.count(F.lit(1)).over(whole()) <= window
    return F.when(few, zscore(x, short)).otherwise(zscore(x, window))


def slope(x, n: int, index: str = "row_index") -> Column:
    """Least-squares slope against the row index over n rows, null if a value is missing: from running sums, as rows' indexes are consecutive."""
    x, i = _c(x).cast("double"), F.col(index).cast("double")
    middle = i - (n - 1) / 2
    return F.when(known(x, n), (prefix_total(x * i, n) - middle * prefix_total(x, n)) / (n * (n * n - 1) / 12))


def indexed(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Adds each row's place in its ticker, from 0."""
    return df.withColumn(name, F.row_number().over(ordered()) - 1)


def percentile(x, percent: float) -> Column:
    """Percentile of the ticker's known values, interpolated."""
    return F.percentile(_c(x), percent / 100).over(whole())


def held(condition: Column, n: int) -> Column:
    """Whether the condition held on n rows in a row."""
    return F.sum(truth(condition).cast("int")).over(frame(n)) == n


def forward_fill(x) -> Column:
    return F.last(_c(x), ignorenulls=True).over(running())


def cumulative(x) -> Column:
    return F.sum(_c(x)).over(running())


def weighted_mean(x, weight) -> Column:
    """Aggregate: mean of x weighted by ``weight``."""
    return F.try_divide(F.sum(_c(x) * _c(weight)), F.sum(_c(weight)))


#: Eras end where the next begins (fixed values).
ERA_STARTS = ["1997-01-01", "2003-01-01", "2009-01-01", "2017-01-01", "2020-01-01"]


def era(time: Column | str = TIME) -> Column:
    """Number of eras that began by the date, from 0."""
    return sum((F.when(_c(time) >= F.lit(s).cast("date"), 1).otherwise(0) for s in ERA_STARTS), F.lit(0))


def rolling_known(df: DataFrame, x: str, aggregates: dict[str, Callable[[Column], Column]], n: int) -> DataFrame:
    """Adds aggregates over the last n known values of x; rows where x is null get null.

    Known rows are numbered, so frames count known values only; no join brings the rows together again.
    """
    own = Window.partitionBy(KEY, F.col(x).isNull()).orderBy(TIME)
    full = F.col(x).isNotNull() & (F.row_number().over(own) >= n)
    return df.withColumns({name: F.when(full, f(F.col(x)).over(own.rowsBetween(-(n - 1), 0))) for name, f in aggregates.items()})


def windows(df: DataFrame, wanted: dict[str, tuple[Callable[[Column], Column], str, int]]) -> DataFrame:
    """Adds a caller's own window functions: by new column the aggregate, the column that it reads and its rows; null until all rows are known."""
    return df.withColumns({name: rolling(f, x, n) for name, (f, x, n) in wanted.items()})


def islands(condition: Column) -> Column:
    """Number of the run of equal truth values that the row is in."""
    c = truth(condition)
    return F.sum(F.when(c == F.lag(c).over(ordered()), 0).otherwise(1)).over(running())
