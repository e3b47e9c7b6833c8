"""Road traffic on a 15-minute grid: features of the interval, summaries, and a seeded simulation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPEEDING, MILES = 70.0, 5.0


def interval_index() -> Column:
    return (F.hour("datetime") * 4 + F.floor(F.minute("datetime") / 15)).cast("double")


def features(vehicles: DataFrame) -> DataFrame:
    """Adds volume (rows of the interval), weekday, interval_index, its place on the circle, and fourth roots."""
    angle = F.radians(F.col("interval_index") * 360 / 96)
    return vehicles.withColumns({
        "volume": F.count(F.lit(1)).over(Window.partitionBy("datetime")),
        "weekday": F.dayofweek(F.to_date("datetime")).between(2, 6),
        "interval_index": interval_index(),
    }).withColumns({
        "interval_cos": F.cos(angle), "interval_sin": F.sin(angle),
        "root4_velocity": F.pow("velocity", F.lit(0.25)), "root4_travel_time": F.pow("travel_time", F.lit(0.25)),
    })


def label_encoding(vehicles: DataFrame) -> DataFrame:
    """Adds vehicle_encoding: the type's rank among the types present in the interval."""
    return vehicles.withColumn("vehicle_encoding", F.dense_rank().over(Window.partitionBy("datetime").orderBy("vehicle_type")) - 1)


def daily_id(vehicles: DataFrame, tiebreak: str = "id") -> DataFrame:
    """Adds day_id: the row's number within its day."""
    return vehicles.withColumn("day_id", F.row_number().over(Window.partitionBy(F.to_date("datetime")).orderBy("datetime", tiebreak)))


def _spread(*columns: str) -> list[Column]:
    return [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("stddev", F.stddev_samp), ("min", F.min), ("max", F.max))]


def time_of_day(rows: DataFrame, group: str) -> DataFrame:
    return rows.groupBy("interval_index", group).agg(F.count("*").alias("count"), *_spread("velocity", "travel_time"))


def volume_distribution(rows: DataFrame) -> DataFrame:
    """Mean and deviation of volume by interval, each vehicle's row counting once."""
    return rows.groupBy("interval_index").agg(F.count("*").alias("count"), F.avg("volume").alias("mean_volume"), F.stddev_samp("volume").alias("stddev_volume"))


def cluster_summary(rows: DataFrame, group: str = "cluster_num") -> DataFrame:
    return rows.groupBy(group).agg(F.count("*").alias("count"), F.count_if(F.col("velocity") >= SPEEDING).alias("speeders_count"), *_spread("velocity", "travel_time"))


def frequencies(rows: DataFrame, group: str = "cluster_num") -> DataFrame:
    return rows.groupBy(group, "interval_index").agg(F.count("*").alias("frequency"))


def shares(rows: DataFrame, group: str = "cluster_num") -> DataFrame:
    """Travel times of each group in each interval, and the group's share of the interval."""
    out = rows.groupBy("interval_index", group).agg(F.count("*").alias("count"), F.avg("travel_time").alias("mean_cluster_time"), F.stddev_samp("travel_time").alias("stddev_cluster_time"))
    return out.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy("interval_index")))


def log_time(rows: DataFrame) -> DataFrame:
    x = F.log(F.when(F.col("travel_time") > 0, F.col("travel_time")))
    return rows.agg(F.avg(x).alias("mean_log_time"), F.stddev_samp(x).alias("stddev_log_time"))


def accident_details(rows: DataFrame) -> DataFrame:
    return rows.where("accident = 1")


def speeding_by_slot(rows: DataFrame) -> DataFrame:
    """Vehicles and speeders by time of day."""
    out = rows.groupBy("interval_index").agg(F.count("*").alias("vehicles"), F.count_if(F.col("velocity") >= SPEEDING).alias("speeders"))
    return out.withColumn("percent_speeding", F.col("speeders") * 100 / F.col("vehicles"))


def accident_rate(rows: DataFrame) -> DataFrame:
    """Intervals with an accident per million vehicle miles."""
    hit = F.count_distinct(F.when(F.col("accident") == 1, F.col("datetime")))
    return rows.agg(hit.alias("accident_intervals"), F.count("*").alias("vehicles")).withColumn("accident_rate", F.try_divide(F.col("accident_intervals").cast("double"), F.col("vehicles") * MILES / 1e6))


def weighted_speed(rows: DataFrame) -> DataFrame:
    """Mean speed weighted by the vehicles of each interval, and the minutes for the road at that speed."""
    each = rows.groupBy("datetime").agg(F.avg("velocity").alias("v"), F.count("velocity").alias("n"))
    return each.agg(F.try_divide(F.sum(F.col("v") * F.col("n")), F.sum("n")).alias("mean_speed")).withColumn("mean_minutes", F.try_divide(F.lit(60.0), F.col("mean_speed")) * MILES)


def kpis(rows: DataFrame, group: str = "scenario") -> DataFrame:
    """For each scenario: accidents per million miles, percent speeding, mean minutes."""
    n = F.count("*")
    return rows.groupBy(group).agg(
        n.alias("vehicles"), F.sum("accident").cast("long").alias("accidents"), (F.sum("accident") / (n * MILES / 1e6)).alias("accident_rate"),
        (F.count_if(F.col("velocity") >= SPEEDING) * 100 / n).alias("percent_speeding"), F.avg("travel_time").alias("mean_time"),
    )


def lower_share_threshold(rows: DataFrame, column: str = "travel_time", share: float = 0.2, parts: int = 64) -> DataFrame:
    """The least value whose percent rank is ``share`` or more.

    Percent rank is (rows below) / (rows - 1). Rows are counted by value, values dealt into parts by approximate quantiles (any bounds
    give the exact result), and rows below counted within the parts; no task ranks all rows.
    """
    known = rows.where(F.col(column).isNotNull())
    bounds = sorted(set(known.approxQuantile(column, [i / parts for i in range(1, parts)], 0.01)))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(column))) if bounds else F.lit(0)
    counts = known.groupBy(column).agg(F.count("*").alias("n")).withColumn("part", part)
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    sums = counts.groupBy("part").agg(F.sum("n").alias("held"))
    before = sums.select("part", F.coalesce(F.sum("held").over(upto), F.lit(0)).alias("before"), F.sum("held").over(Window.partitionBy(F.lit(0))).alias("total"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = counts.join(F.broadcast(before), "part").withColumn("below", F.col("before") + inside)
    return below.where((F.col("total") <= 1) | (F.col("below") >= share * (F.col("total") - 1))).agg(F.min(column).alias("threshold"))


#: Speed of each vehicle type (mean, deviation), and for each part of the day: until when, speed factor,
#: share of the types in that order, vehicles per minute (fixed values of the simulated road).
TYPES = {"car": (61, 11), "suv": (58, 13), "truck": (55, 12), "18_wheeler": (51, 6), "service_vans": (53, 13)}
WEEKDAY = [
    ("05:00", 0.925, [0.13, 0.11, 0.14, 0.56, 0.06], 18), ("06:59", 1.0, [0.14, 0.16, 0.20, 0.27, 0.23], 51),
    ("09:30", 0.70, [0.24, 0.23, 0.18, 0.11, 0.24], 89), ("16:29", 0.975, [0.31, 0.28, 0.14, 0.09, 0.18], 71),
    ("19:00", 0.65, [0.23, 0.22, 0.18, 0.10, 0.27], 86), ("21:59", 1.0, [0.31, 0.30, 0.24, 0.07, 0.08], 55),
    ("23:59", 1.10, [0.33, 0.31, 0.21, 0.10, 0.05], 27),
]
WEEKEND = [
    ("04:00", 1.2, [0.47, 0.24, 0.14, 0.12, 0.03], 25), ("08:00", 0.90, [0.27, 0.24, 0.21, 0.16, 0.12], 31),
    ("13:00", 0.85, [0.31, 0.32, 0.24, 0.07, 0.06], 64), ("20:00", 1.0, [0.32, 0.30, 0.25, 0.05, 0.08], 66),
    ("23:59", 1.05, [0.36, 0.30, 0.22, 0.10, 0.02], 42),
]
#: Accidents per 200,000 vehicles by speed band, lanes left open, minutes of an accident (fixed values).
RISK_BANDS, RISKS = [30, 45, 55, 65, 75], [1.0, 1.25, 1.75, 2.75, 5.25, 15.0]
LANES_OPEN, DURATIONS = [2, 1, 0], [30, 60, 90, 120, 150]


def simulate(spark: SparkSession, first_day: str, days: int, seed: int = 7) -> DataFrame:
    """Vehicles (datetime, vehicle_type, velocity, accident) of simulated days.

    An accident slows the intervals after it, so a day is one sequence; days are independent and seeded by their date.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        day = pd.Timestamp(frame.day.iloc[0])
        rng = np.random.default_rng([seed, day.toordinal()])
        plan = WEEKDAY if day.weekday() < 5 else WEEKEND
        kinds, speeds = list(TYPES), np.array(list(TYPES.values()), float)
        open_lanes, left, out = None, 0.0, []
        for i in range(96):
            at = day + pd.Timedelta(minutes=15 * i)
            _, factor, mix, rate = next(p for p in plan if f"{at:%H:%M}" <= p[0])
            n = int(rng.normal(rate, 5)) * 15
            if open_lanes is not None:
                left -= 1
                open_lanes = open_lanes if left >= 0 else None
            slow = 1.0 if open_lanes is None else (open_lanes or 0.25) / 3
            n = max(0, int(n * slow))
            if not n:
                continue
            crowd = 750 / n if n > 750 else 1.0
            factors = rng.normal(factor, 0.05, n) * slow * crowd
            kind = rng.choice(len(kinds), n, p=mix)
            v = rng.normal(speeds[kind, 0], speeds[kind, 1]) * factors
            while (bad := v <= 0).any():
                v[bad] = rng.normal(speeds[kind[bad], 0], speeds[kind[bad], 1]) * np.abs(factors[bad])
            crash = np.zeros(n, int)
            if open_lanes is None:
                hits = np.flatnonzero(rng.random(n) < np.array(RISKS)[np.searchsorted(RISK_BANDS, v)] / 200_000)
                if hits.size:  # the first one closes lanes; none follows while it lasts
                    crash[hits[0]] = 1
                    open_lanes, left = int(rng.choice(LANES_OPEN)), float(rng.choice(DURATIONS)) / 15
            out.append(pd.DataFrame({"datetime": at, "vehicle_type": np.array(kinds)[kind], "velocity": v, "accident": crash}))
        return pd.concat(out)

    dates = spark.range(days).select(F.date_add(F.lit(first_day).cast("date"), F.col("id").cast("int")).alias("day"))
    return dates.groupBy("day").applyInPandas(run, "datetime timestamp_ntz, vehicle_type string, velocity double, accident int")
