"""Files and tables read and written: prices, traffic days, scenario results, and calls with a rate limit."""

from __future__ import annotations

import logging
import threading
import time
from collections import deque
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAFFIC_DAY = "id bigint, datetime timestamp_ntz, vehicle_type string, vehicle_encoding int, velocity double, travel_time double, accident int"
FORECAST_DAY = "id bigint, datetime timestamp_ntz, cluster_num int, velocity double, travel_time double, accident int"


def read_traffic(spark: SparkSession, path: str, forecast: bool = False) -> DataFrame:
    """CSV files with a header, by an explicit schema; a path may be a glob."""
    return spark.read.schema(FORECAST_DAY if forecast else TRAFFIC_DAY).csv(path, header=True)


#: Price payloads: a JSON array of days for each ticker, in a file named by the ticker.
PRICE_DAY = "date string, open double, high double, low double, close double, volume bigint, splitFactor double"
VEHICLE = "vehicle_type string, velocity double, accident int"
_INTERVAL_NAME = r"dt_(\d{4}_\d{2}_\d{2}_\d{2}_\d{2}_\d{2})"


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Price payloads dropped as files, by an explicit schema: ticker (the file's name), date and the day's prices to four places; days without a close are left out."""
    days = spark.read.schema(PRICE_DAY).json(path, multiLine=True)
    ticker = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.json$", 1)
    prices = {c: F.round(c, 4).alias(c) for c in ("open", "high", "low", "close")}
    return days.select(F.lower(ticker).alias("ticker"), F.to_date(F.substring("date", 1, 10)).alias("date"), *prices.values(), "volume", F.coalesce("splitFactor", F.lit(1.0)).alias("splitFactor")).where("close is not null")


def interval_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Names of the catalog's tables that hold an interval."""
    return sorted(t.name for t in spark.catalog.listTables(database, "dt_*"))


def read_intervals(spark: SparkSession, path: str, schema: str = VEHICLE) -> DataFrame:
    """Parquet of many intervals (files or folders named dt_2024_06_01_00_15_00, by a glob) as one scan with a datetime from the name."""
    name = F.regexp_extract(F.col("_metadata.file_path"), _INTERVAL_NAME, 1)
    return spark.read.schema(schema).parquet(path).select("*", F.to_timestamp_ntz(name, F.lit("yyyy_MM_dd_HH_mm_ss")).alias("datetime"))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by an explicit schema."""
    return spark.read.schema(schema).json(path)


#: Result sets of a scenario.
RESULTS = ("cluster_summary", "cluster_frequencies", "accidents_details", "time_of_day_summary", "model_evaluation_metrics")


def write_result_sets(results: dict[str, DataFrame], path: str) -> None:
    """Each result set as JSON lines by scenario, in a folder of its own."""
    unknown = set(results) - set(RESULTS)
    if unknown:
        raise ValueError(f"not a result set: {sorted(unknown)}")
    for name, df in results.items():
        df.write.partitionBy("scenario").mode("overwrite").json(f"{path}/{name}")


def read_result_set(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A result set of all scenarios, as it was written."""
    return spark.read.schema(f"{schema}, scenario string").json(f"{path}/{name}")


def write_partitioned(df: DataFrame, path: str, columns: tuple[str, ...] = ("exchange", "cap", "sector", "ticker")) -> None:
    """Parquet by partition; only partitions that ``df`` holds are replaced."""
    df.repartition(*columns).write.partitionBy(*columns).mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(path)


def write_days(df: DataFrame, path: str, columns: tuple[str, ...] = ("scenario", "day")) -> None:
    """CSV with a header by scenario and day, in one job."""
    df.withColumn("day", F.to_date("datetime")).repartition(*columns).write.partitionBy(*columns).mode("overwrite").csv(path, header=True)


def write_results(df: DataFrame, path: str) -> None:
    """JSON lines by scenario."""
    df.write.partitionBy("scenario").mode("overwrite").json(path)


def append_rows(spark: SparkSession, table: str, df: DataFrame, keys: list[str]) -> None:
    """Create the table, or append the rows whose key it does not hold."""
    if not spark.catalog.tableExists(table):
        df.dropDuplicates(keys).write.saveAsTable(table)
        return
    fresh = df.join(spark.table(table).select(*keys), keys, "left_anti").dropDuplicates(keys)
    fresh.write.mode("append").saveAsTable(table)


def compact(spark: SparkSession, source: str, target: str, files: int) -> None:
    """A copy of Parquet files in ``files`` files."""
    spark.read.parquet(source).repartition(files).write.mode("overwrite").parquet(target)


def stale_partitions(stored: DataFrame, listing: DataFrame, columns: tuple[str, ...] = ("exchange", "cap", "sector", "ticker")) -> DataFrame:
    """Partition values that no listing has any more."""
    return stored.select(*columns).distinct().join(listing.select(*columns).distinct(), list(columns), "left_anti")


def table_columns(spark: SparkSession, table: str) -> dict[str, str]:
    """Column types of a table, none where it does not exist."""
    return {c.name: c.dataType for c in spark.catalog.listColumns(table)} if spark.catalog.tableExists(table) else {}


def retrying(attempts: int = 5, wait: float = 1.0, growth: float = 2.0, errors: tuple[type[Exception], ...] = (OSError,), sleep: Callable[[float], None] = time.sleep):
    """Calls again after an error, each time after a longer wait; the last error is raised."""

    def decorate(function):
        @wraps(function)
        def tried(*args, **kwargs):
            for attempt in range(attempts):
                try:
                    return function(*args, **kwargs)
                except errors:
                    if attempt == attempts - 1:
                        raise
                    sleep(wait * growth**attempt)

        return tried

    return decorate


def logged(function):
    """Logs a call's name and seconds."""

    @wraps(function)
    def timed(*args, **kwargs):
        began = time.monotonic()
        try:
            return function(*args, **kwargs)
        finally:
            logging.getLogger(function.__module__).info("%s: %.3f s", function.__qualname__, time.monotonic() - began)

    return timed


class Limit:
    """At most ``calls`` calls in ``seconds``; further ones wait."""

    def __init__(self, calls: int, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.calls, self.seconds, self.clock, self.sleep = calls, seconds, clock, sleep
        self.made: deque[float] = deque()
        self.lock = threading.Lock()

    def wait(self) -> None:
        with self.lock:
            while True:
                now = self.clock()
                while self.made and now - self.made[0] >= self.seconds:
                    self.made.popleft()
                if len(self.made) < self.calls:
                    self.made.append(now)
                    return
                self.sleep(self.seconds - (now - self.made[0]))

    def __call__(self, function):
        @wraps(function)
        def limited(*args, **kwargs):
            self.wait()
            return function(*args, **kwargs)

        return limited
