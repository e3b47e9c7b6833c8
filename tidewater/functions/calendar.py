"""Calendar predicates as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def is_weekday(day: Column) -> Column:
    return F.dayofweek(day).between(2, 6)


def nth_friday(day: Column, n: int) -> Column:
    """Whether the day is the n-th Friday of its month."""
    return (F.dayofweek(day) == 6) & (F.ceil(F.dayofmonth(day) / 7) == n)


def days(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row for each day."""
    return spark.sql("SELECT explode(sequence(cast(:a as date), cast(:b as date))) AS date", args={"a": first, "b": last})


def market_open(day: Column, holidays: list[str]) -> Column:
    """Whether the exchange is open: on weekdays that are no holidays."""
    return is_weekday(day) & (~day.cast("string").isin(holidays) if holidays else F.lit(True))
