"""Indicators that window expressions can state. Each takes bars (ticker, date, open, high, low, close, volume) and adds columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w

EXTREME_WINDOW, EXTREME_SHORT = 250, 120


def price_ceilings(df: DataFrame, upper: float = 99, lower: float = 1) -> DataFrame:
    """priceChange, priceCeiling and priceFloor: within an era, the close before plus the era's extreme percentiles of change."""
    df = df.withColumn("_era", w.era())
    era = Window.partitionBy(w.KEY, "_era")
    before = F.lag("close").over(era.orderBy(w.TIME))
    df = df.withColumn("_before", before).withColumn("priceChange", F.col("close") - F.col("_before"))
    bound = lambda p: F.col("_before") + F.percentile("priceChange", p / 100).over(era)
    return df.withColumn("priceCeiling", bound(upper)).withColumn("priceFloor", bound(lower)).drop("_era", "_before")


def demand_pressure(df: DataFrame, period: int = 10, price_range: int = 2) -> DataFrame:
    """demandRaw: the smaller over the larger of buying and selling pressure, before smoothing."""
    df = df.withColumn("_range", w.high("high", price_range) - w.low("low", price_range))
    spread = w.mean("_range", period)
    move = F.try_divide(F.col("close") - F.col("open"), F.col("open")) * F.try_divide(3 * F.col("close"), spread)
    df = df.withColumn("_move", move)
    other = F.try_divide(F.col("volume").cast("double"), F.col("_move"))
    up = F.col("close") > F.col("open")
    volume = F.col("volume").cast("double")
    # without movement the other side's pressure is infinite, unless nothing was traded
    infinite = F.when((F.col("_move") == 0) & (volume > 0), F.lit(0.0))
    buying, selling = F.when(up, volume).otherwise(other), F.when(up, other).otherwise(volume)
    raw = F.when(F.abs(buying) > F.abs(selling), F.try_divide(selling, buying)).otherwise(F.try_divide(buying, selling))
    return df.withColumn("demandRaw", F.coalesce(infinite, raw)).drop("_range", "_move")


def extremes_distance(df: DataFrame) -> DataFrame:
    """percentDiffMax and percentDiffMin: distance of the close from the high or low of 250 rows (120 in a ticker of 120 to 250 rows), in percent of their mean."""
    n = F.count(F.lit(1)).over(w.whole())

    def distance(f, x):
        far = F.when((n >= EXTREME_SHORT) & (n <= EXTREME_WINDOW), f(x, EXTREME_SHORT)).when(n > EXTREME_WINDOW, f(x, EXTREME_WINDOW))
        return F.try_divide(F.abs(F.col("close") - far), (F.col("close") + far) / 2) * 100

    return df.withColumn("percentDiffMax", distance(w.high, "high")).withColumn("percentDiffMin", distance(w.low, "low"))


def aroon(df: DataFrame, n: int = 20) -> DataFrame:
    """aroon{n}: rows since the window's first low less rows since its first high, in percent of n."""
    highs, lows = (F.collect_list(x).over(w.frame(n)) for x in ("high", "low"))
    full = F.count(F.col("high")).over(w.frame(n)) == n
    since = lambda values, extreme: n - F.array_position(values, extreme(values))
    value = 100.0 * (since(lows, F.array_min) - since(highs, F.array_max)) / n
    return df.withColumn(f"aroon{n}", F.when(full & (F.count(F.col("low")).over(w.frame(n)) == n), value))


def cci(df: DataFrame, n: int = 20, smooth: int = 14) -> DataFrame:
    """cci{n} and its moving average: typical price against its mean, in units of mean absolute deviation."""
    df = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3).withColumn("_mean", w.mean("_tp", n))
    df = df.withColumn("_values", F.collect_list("_tp").over(w.frame(n)))
    spread = F.aggregate("_values", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("_mean"))) / n
    df = df.withColumn(f"cci{n}", F.try_divide(F.col("_tp") - F.col("_mean"), 0.015 * spread))
    return df.withColumn(f"cci{n}_ma{smooth}", w.total(f"cci{n}", smooth) / smooth).drop("_tp", "_mean", "_values")


def deviation_percent(df: DataFrame, n: int = 20) -> DataFrame:
    """STDevPercent{n}: deviation of the close in percent of its mean."""
    return df.withColumn(f"STDevPercent{n}", F.try_divide(w.deviation("close", n), w.mean("close", n)) * 100)


def bollinger(df: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    mean, spread = w.mean("close", n), w.deviation("close", n)
    df = df.withColumn(f"bollingerSMA{n}", mean).withColumn(f"bollingerUpper{n}", mean + width * spread).withColumn(f"bollingerLower{n}", mean - width * spread)
    return df.withColumn(f"bollingerRange{n}", F.col(f"bollingerUpper{n}") - F.col(f"bollingerLower{n}"))


#: Rate-of-change periods, their smoothing and their weights.
KST = [(10, 10, 1), (15, 10, 2), (20, 10, 3), (30, 15, 4)]


def kst(df: DataFrame, signal: int = 9) -> DataFrame:
    """kst: weighted sum of smoothed rates of change; kstSig: its moving average."""
    for roc, _, _ in KST:
        df = df.withColumn(f"_roc{roc}", F.try_divide(w.change("close", roc), w.lag("close", roc)) * 100)
    df = df.withColumn("kst", sum((w.mean(f"_roc{roc}", smooth) * weight for roc, smooth, weight in KST[1:]), w.mean(f"_roc{KST[0][0]}", KST[0][1]) * KST[0][2]))
    return df.withColumn("kstSig", w.mean("kst", signal)).drop(*(f"_roc{roc}" for roc, _, _ in KST))


def williams_r(df: DataFrame, n: int = 14) -> DataFrame:
    top, bottom = w.high("high", n), w.low("low", n)
    return df.withColumn(f"williamsR{n}", F.try_divide(top - F.col("close"), top - bottom) * -100)


def stochastic(df: DataFrame, n: int = 20, smooth: int = 3) -> DataFrame:
    top, bottom = w.high("high", n), w.low("low", n)
    df = df.withColumn(f"stochasticK{n}", F.try_divide(F.col("close") - bottom, top - bottom) * 100)
    return df.withColumn(f"stochasticD{n}", w.mean(f"stochasticK{n}", smooth))


def on_balance_volume(df: DataFrame, n: int = 10) -> DataFrame:
    """OBV: volume signed by the day's direction (the first row: 0), over n rows."""
    df = df.withColumn("_signed", F.coalesce(F.signum(w.change("close")), F.lit(0.0)) * F.col("volume"))
    return df.withColumn("OBV", w.total("_signed", n)).drop("_signed")


#: Trend periods in rows.
TRENDS = {"twoWeek": 10, "month": 20, "threeMonth": 60, "sixMonth": 120, "year": 250, "threeYear": 750}


def trend_lines(df: DataFrame, source: str = "kama20", periods: dict[str, int] | None = None) -> DataFrame:
    """{name}TrendLine: slope of the source's z-score; {name}Trend: 1 from its 75th percentile up, -1 from its 25th down, else 0.

    A period is null where the ticker has fewer than 20 rows more than it. ``prevailing`` repeats the two-week trend.
    """
    periods = periods or TRENDS
    df = w.indexed(df).withColumn("_z", w.rolling_zscore(source)).withColumn("_n", F.count(F.lit(1)).over(w.whole()))
    for name, n in periods.items():
        line = f"{name}TrendLine"
        df = df.withColumn(line, F.when(F.col("_n") >= n + 20, w.slope("_z", n)))
        upper, lower = w.percentile(line, 75), w.percentile(line, 25)
        df = df.withColumn(f"{name}Trend", F.when(F.col("_n") < n + 20, F.lit(None).cast("int")).when(w.truth(F.col(line) >= upper), 1).when(w.truth(F.col(line) <= lower), -1).otherwise(0))
    first = next(iter(periods))
    return df.withColumn("prevailingTrendLine", F.col(f"{first}TrendLine")).withColumn("prevailingTrend", F.col(f"{first}Trend")).drop("_z", "_n", "row_index")


def _price(x: Column, places: int | None) -> Column:
    return x if places is None else F.round(x, places)


def split_adjust(df: DataFrame, factor: str = "splitFactor", tolerance: float = 0.25, places: int | None = 4) -> DataFrame:
    """Prices divided and volume multiplied by all later splits that the closes confirm, rounded to ``places``.

    A split counts if the close lies within ``tolerance`` of the close before, divided by the factor.
    """
    before = F.try_divide(w.lag("close"), F.col(factor))
    counts = w.truth((F.col(factor) != 1) & (F.col("close") > before * (1 - tolerance)) & (F.col("close") < before * (1 + tolerance)))
    later = w.ordered().rowsBetween(1, Window.unboundedFollowing)
    df = df.withColumn("_f", F.when(counts, F.col(factor))).withColumn("_later", F.coalesce(F.product("_f").over(later), F.lit(1.0)))
    for c in ("open", "high", "low", "close"):
        df = df.withColumn(c, _price(F.col(c) / F.col("_later"), places))
    return df.withColumn("volume", F.round(F.col("volume") * F.col("_later")).cast("long")).drop("_f", "_later")


def split_restore(df: DataFrame, factor: str = "splitFactor", places: int | None = 4) -> DataFrame:
    """The inverse, for every split: prices multiplied and volume divided by all later factors."""
    later = w.ordered().rowsBetween(1, Window.unboundedFollowing)
    df = df.withColumn("_later", F.coalesce(F.product(factor).over(later), F.lit(1.0)))
    for c in ("open", "high", "low", "close"):
        df = df.withColumn(c, _price(F.col(c) * F.col("_later"), places))
    return df.withColumn("volume", F.round(F.try_divide(F.col("volume").cast("double"), F.col("_later"))).cast("long")).drop("_later")


def split_append(stored: DataFrame, new: DataFrame, factor: str = "splitFactor", places: int | None = 4) -> DataFrame:
    """Stored history rescaled by the splits of the new rows (each counts), with the new rows after it."""
    splits = new.where(F.col(factor) != 1).groupBy(w.KEY).agg(F.product(factor).alias("_f"))
    old = stored.join(splits, w.KEY, "left").withColumn("_f", F.coalesce("_f", F.lit(1.0)))
    for c in ("open", "high", "low", "close"):
        old = old.withColumn(c, _price(F.col(c) / F.col("_f"), places))
    return old.withColumn("volume", F.round(F.col("volume") * F.col("_f")).cast("long")).drop("_f").unionByName(new, allowMissingColumns=True)


def activity_check(df: DataFrame, threshold: float = 25_000, least: int = 120, window: int = 20) -> DataFrame:
    """For each ticker: designation, whether it passes, and which dates to keep (keep_from, keep_to).

    A row fails if the mean of close times volume over ``window`` rows is at most ``threshold``. Runs of passing rows
    longer than ``least`` are valid.
    """
    df = df.withColumn("_fails", w.truth(w.mean(F.col("close") * F.col("volume"), window) <= threshold))
    df = df.withColumn("_run", w.islands(~F.col("_fails")))
    runs = df.groupBy(w.KEY, "_run").agg(F.first("_fails").alias("fails"), F.count("*").alias("n"), F.min(w.TIME).alias("a"), F.max(w.TIME).alias("b"))
    valid = ~F.col("fails") & (F.col("n") > least)
    t = runs.groupBy(w.KEY).agg(F.sum("n").alias("rows"), F.max(F.col("fails").cast("int")).alias("any"), F.max("b").alias("last"), F.min(F.when(valid, F.col("a"))).alias("first_valid"), F.max(F.when(valid, F.col("b"))).alias("last_valid"))
    short, clean = F.col("rows") < least, F.col("any") == 0
    label = F.when(short, "notEnoughData").when(clean, "active").when(F.col("first_valid").isNull(), "deadTicker").when(F.col("last_valid") == F.col("last"), "active").otherwise("recentDatesInactive")
    trimmed = ~short & ~clean & F.col("first_valid").isNotNull()
    return t.select(
        w.KEY, label.alias("designation"), (~short & clean).alias("passes"),
        F.when(trimmed & (F.col("last_valid") == F.col("last")), F.col("first_valid")).alias("keep_from"),
        F.when(trimmed & (F.col("last_valid") != F.col("last")), F.col("last_valid")).alias("keep_to"),
    )
