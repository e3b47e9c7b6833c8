"""Market breadth: counters for each date over all tickers, and measures over the dates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w

COUNTERS = ["advances", "declines", "unchanged", "advancingVolume", "decliningVolume", "unchangedVolume", "newHighs", "newLows"]


def counters(bars: DataFrame) -> DataFrame:
    """Rows that rose, fell or stood still against the ticker's day before, their volumes, and new extremes of the close so far."""
    before = w.lag("close")
    rows = bars.select("date", "volume", "close", before.alias("before"), F.max("close").over(w.running()).alias("top"), F.min("close").over(w.running()).alias("bottom"))
    tests = {"advances": F.col("close") > F.col("before"), "declines": F.col("close") < F.col("before"), "unchanged": F.col("close") == F.col("before")}
    counts = {name: F.count_if(t) for name, t in tests.items()}
    for name, t in zip(COUNTERS[3:6], tests.values(), strict=True):
        counts[name] = F.coalesce(F.sum(F.when(t, F.col("volume"))), F.lit(0))
    counts |= {"newHighs": F.count_if(F.col("close") >= F.col("top")), "newLows": F.count_if(F.col("close") <= F.col("bottom"))}
    return rows.groupBy("date").agg(*(c.cast("long").alias(name) for name, c in counts.items()))


def _dates() -> Window:
    return Window.partitionBy(F.lit(0)).orderBy("date")


def measures(daily: DataFrame) -> DataFrame:
    """Adds adLine, newHighLowIndex, trin and breadthOBV to the counters. The table has a row for each date, so one task orders it."""
    upto = _dates().rowsBetween(Window.unboundedPreceding, 0)
    ten = _dates().rowsBetween(-9, 0)
    share = F.try_divide(F.col("newHighs").cast("double"), (F.col("newHighs") + F.col("newLows")).cast("double"))
    daily = daily.withColumn("adLine", F.sum(F.col("advances") - F.col("declines")).over(upto)).withColumn("_share", share)
    daily = daily.withColumn("newHighLowIndex", F.when(F.count("_share").over(ten) == 10, F.avg("_share").over(ten))).drop("_share")
    ratio = F.try_divide(F.col("advances").cast("double"), F.col("declines").cast("double"))
    daily = daily.withColumn("trin", F.try_divide(ratio, (F.col("advancingVolume") + F.col("decliningVolume")).cast("double")))
    flow = F.try_divide(F.col("advancingVolume").cast("double"), F.col("decliningVolume").cast("double"))
    return daily.withColumn("breadthOBV", F.sum(flow).over(upto))


def mcclellan(daily: DataFrame, fast: int = 19, slow: int = 39) -> DataFrame:
    """Adds mcclellan: the difference of two exponential means of the A/D line, over the one series of dates."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        line = frame.sort_values("date")
        line["mcclellan"] = line.adLine.ewm(span=fast).mean() - line.adLine.ewm(span=slow).mean()
        return line[["date", "mcclellan"]]

    series = daily.select("date", "adLine", F.lit(0).alias("_all")).groupBy("_all").applyInPandas(run, "date date, mcclellan double")
    return daily.join(series, "date")


def since(daily: DataFrame, last) -> DataFrame:
    """The dates from the last stored one on: cumulative measures are made from the whole history first."""
    return daily.where(F.col("date") >= F.lit(last))
