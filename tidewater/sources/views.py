"""Canonical views: bars, listing, traffic and statements over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def known(x: Column) -> Column:
    """NaN becomes null: applied where data enters, so that counts and comparisons see one kind of missing value."""
    return F.when(~F.isnan(x), x)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars (ticker, date, open, high, low, close, volume): one row for each supplier and shipping day."""
    px = F.col("l_extendedprice") / F.col("l_quantity")
    first = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date"), known(px).alias("px"), first.alias("at"), "l_quantity")
    return rows.groupBy("ticker", "date").agg(
        F.min_by("px", "at").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "at").alias("close"), F.sum("l_quantity").cast("long").alias("volume")
    )


def capital_category(cap: Column) -> Column:
    """Size class of a market capitalisation; null is Unknown."""
    return F.when(cap.isNull(), "Unknown").when(cap >= 2e11, "Mega").when(cap >= 1e10, "Large").when(cap >= 2e9, "Mid").when(cap >= 3e8, "Small").otherwise("Micro")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings (ticker, exchange, sector, cap): suppliers with their nation and region."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(F.col("s_suppkey").alias("ticker"), F.col("n_name").alias("exchange"), F.col("r_name").alias("sector"), capital_category(F.col("s_acctbal") * 3e7).alias("cap"))


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles (id, datetime, vehicle_type, velocity, travel_time, accident) from events, on a 15-minute grid."""
    ts = F.col("ts")
    slot = F.date_trunc("hour", ts).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.minute(ts) / 15).cast("int") * 15)
    e = table(spark, sf_dir, "events").withColumn("velocity", known(F.col("value").cast("double")))
    return e.select(F.col("event_id").alias("id"), slot.alias("datetime"), F.col("event_type").alias("vehicle_type"), "velocity", (F.try_divide(F.lit(60.0), F.col("velocity")) * 5).alias("travel_time"), (F.col("event_type") == "error").cast("int").alias("accident"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly statement entries in long form (ticker, date, stmt_type, dataCode, value) from orders."""
    o = table(spark, sf_dir, "orders")
    price, status, priority = F.col("o_totalprice"), F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    quarter = F.to_date(F.date_trunc("quarter", "o_orderdate"))
    codes = [
        ("incomeStatement", "revenue", price),
        ("incomeStatement", "netinc", F.when(status == "F", price).otherwise(0.0)),
        ("incomeStatement", "grossProfit", F.when(status != "P", price).otherwise(0.0)),
        ("incomeStatement", "opinc", F.when(priority <= "3", price).otherwise(0.0)),
        ("balanceSheet", "equity", F.when(priority == "1", price).otherwise(0.0)),
        ("balanceSheet", "totalAssets", price * 2),
        ("balanceSheet", "assetsCurrent", F.when(priority <= "2", price).otherwise(0.0)),
        ("balanceSheet", "liabilitiesCurrent", F.when(priority >= "4", price).otherwise(0.0)),
        ("balanceSheet", "debt", F.when(status == "O", price).otherwise(0.0)),
        ("cashFlow", "capex", F.when(priority == "5", price).otherwise(0.0)),
    ]
    sums = o.groupBy(F.col("o_custkey").alias("ticker"), quarter.alias("date")).agg(*(F.sum(x).alias(code) for _, code, x in codes))
    entries = F.array(*(F.struct(F.lit(t).alias("stmt_type"), F.lit(c).alias("dataCode"), F.col(c).alias("value")) for t, c, _ in codes))
    return sums.select("ticker", "date", F.explode(entries).alias("x")).select("ticker", "date", "x.*")
