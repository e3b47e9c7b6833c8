"""The listing universe: cleaning, filters, and table changes as pure functions from old rows to new ones."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Exchanges that are listed, and the names that some are kept under (fixed values).
EXCHANGES = ["PINK", "OTCGREY", "EXPM", "OTC", "NYSE", "NASDAQ", "ARCA", "OTCBB", "OTCQB", "OTCCE", "OTCMKTS", "OTCQX", "NYSE ARCA", "NYSE MKT", "BATS"]
CONSOLIDATED = {"OTCBB": "OTC", "OTCQB": "OTC", "OTCCE": "OTC", "OTCMKTS": "OTC", "OTCQX": "OTC", "NYSE ARCA": "ARCA", "NYSE MKT": "ARCA", "BATS": "ARCA", "PINK": "OTCPINK", "EXPM": "OTCEXPM"}


def canonical_ticker() -> Column:
    return F.when(~F.col("duplicated"), F.col("ticker")).otherwise(F.col("permaTicker"))


def exchange_name(exchange: Column, names: dict[str, str] | None = None) -> Column:
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable((names or CONSOLIDATED).items())))
    return F.lower(F.coalesce(F.try_element_at(table, exchange), exchange))


def clean_listing(raw: DataFrame) -> DataFrame:
    """Listed stocks and funds with duplicate flags (the latest start keeps the symbol), exchange names, years listed and designation."""
    rows = raw.where(F.col("exchange").isin(EXCHANGES) & F.col("assetType").isin("Stock", "ETF") & F.col("startDate").isNotNull() & ~F.col("startDate").eqNullSafe(F.col("endDate")))
    newest = Window.partitionBy("ticker").orderBy(F.col("startDate").desc(), "permaTicker")
    return rows.withColumns({
        "duplicated": F.row_number().over(newest) > 1,
        "exchange": exchange_name(F.col("exchange")),
        "assetType": F.lower("assetType"),
        "yearsListed": (F.year("endDate") - F.year("startDate")).cast("long"),
        "designation": F.when(F.col("isActive"), "active").otherwise("delisted"),
    })


def with_profile(listing: DataFrame, profile: DataFrame) -> DataFrame:
    """Listing left-joined with profiles; unknown text is Unknown."""
    out = listing.join(profile, ["permaTicker", "ticker"], "left")
    texts = [f.name for f in profile.schema if f.dataType.simpleString() == "string" and f.name not in ("permaTicker", "ticker")]
    return out.withColumns({c: F.coalesce(c, F.lit("Unknown")) for c in texts})


def price_universe(meta: DataFrame) -> DataFrame:
    return meta.where((F.col("designation") == "active") | ((F.col("designation") != "deadTicker") & ~F.col("pricesInitialized")))


def fundamentals_universe(meta: DataFrame) -> DataFrame:
    return meta.where((F.col("assetType") == "stock") & ((F.col("designation") == "active") | ((F.col("designation") != "deadTicker") & ~F.col("fundamentalsInitialized"))))


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and those new ones whose key is not there; columns that either lacks are null."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def latest(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The latest row of each key; rows of one time in the order of all their columns, nulls last."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(time), *(F.desc_nulls_last(F.col(c).cast("string")) for c in sorted(df.columns)))
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows replaced by new ones with the same key, new keys added; of rows that repeat a key the one that is last by its columns as text stays."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    ties = [F.desc_nulls_last(F.col(c).cast("string")) for c in sorted(set(both.columns) - {"_v", *keys})]
    latest = Window.partitionBy(*keys).orderBy(F.desc("_v"), *ties)
    return both.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_v", "_n")


def update_from(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], when: Column) -> DataFrame:
    """Old rows with ``columns`` taken from the matching new row where ``when`` holds."""
    other = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_m"))
    out = old.join(other, keys, "left")
    change = F.coalesce(F.col("_m"), F.lit(False)) & F.coalesce(when, F.lit(False))
    return out.withColumns({c: F.when(change, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).select(*old.columns)


def delete_not_in(old: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(kept.select(*keys).distinct(), keys, "left_semi")


def delete_where(old: DataFrame, condition: Column) -> DataFrame:
    """Rows without those for which the condition is true; where it is null they stay."""
    return old.where(~F.coalesce(condition, F.lit(False)))


def purge(old: DataFrame, meta: DataFrame, keys: list[str], designations: tuple[str, ...] = ("deadTicker",)) -> DataFrame:
    """Rows without those of dead tickers."""
    return old.join(meta.where(F.col("designation").isin(*designations)).select(*keys).distinct(), keys, "left_anti")


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has: none if ``keys`` is a primary key."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")
