"""Fundamentals: statements from long to wide form, their joins, and ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODES = {
    "balanceSheet": ["equity", "totalAssets", "assetsCurrent", "liabilitiesCurrent", "cashAndEq", "acctRec", "debt", "totalLiabilities", "retainedEarnings"],
    "incomeStatement": ["netinc", "revenue", "grossProfit", "opinc", "ebit", "intexp", "ebitda", "ebt", "opex", "rnd", "sga", "taxExp", "costRev", "consolidatedIncome"],
    "cashFlow": ["capex"],
}

#: Ratios: numerator and denominator (fixed definitions).
RATIOS = {
    "netMargin": ("netinc", "revenue"), "grossMargin": ("grossProfit", "revenue"), "operatingMargin": ("opinc", "revenue"),
    "returnOnEquity": ("netinc", "equity"), "returnOnAssets": ("netinc", "totalAssets"),
    "currentRatio": ("assetsCurrent", "liabilitiesCurrent"), "quickRatio": ("cashAndEq + acctRec", "liabilitiesCurrent"),
    "debtEquity": ("debt", "equity"), "debtAssets": ("totalLiabilities", "totalAssets"), "interestCoverage": ("ebit", "intexp"),
    "assetTurnover": ("revenue", "totalAssets"), "receivablesTurnover": ("revenue", "acctRec"),
}


def unnest(payload: DataFrame) -> DataFrame:
    """Long entries (ticker, date, stmt_type, dataCode, value) from rows with nested arrays by statement type; annual rows (quarter 0) are dropped."""
    kinds = payload.schema["statementData"].dataType.names

    def entries(kind: str):
        return F.transform(F.coalesce(f"statementData.{kind}", F.expr("array()")), lambda x: F.struct(F.lit(kind).alias("stmt_type"), x["dataCode"].alias("dataCode"), x["value"].alias("value")))

    parts = F.concat(*map(entries, kinds))
    return payload.where("quarter <> 0").select("ticker", "date", F.explode(parts).alias("x")).select("ticker", "date", "x.*")


def pivot(entries: DataFrame, stmt_type: str, codes: list[str] | None = None) -> DataFrame:
    """One row for each ticker and date with a column for each known code; repeated entries are averaged."""
    return entries.where(F.col("stmt_type") == stmt_type).groupBy("ticker", "date").pivot("dataCode", codes or CODES[stmt_type]).agg(F.avg("value"))


def joined(entries: DataFrame, stmt_types: list[str], codes: dict[str, list[str]] | None = None) -> DataFrame:
    """Inner join by ticker and date of those statement types that a ticker has.

    One pivot over all types stands for the joins: a date stays if it has an entry of every type that its ticker has anywhere.
    """
    codes = codes or CODES
    rows = entries.where(F.col("stmt_type").isin(stmt_types))
    has = rows.groupBy("ticker").agg(F.count_distinct("stmt_type").alias("types"))
    names = [c for t in stmt_types for c in codes[t]]
    wide = rows.groupBy("ticker", "date").agg(F.count_distinct("stmt_type").alias("n"), *(F.avg(F.when(F.col("dataCode") == c, F.col("value"))).alias(c) for c in names))
    return wide.join(has, "ticker").where("n = types").drop("n", "types")


def ratios(wide: DataFrame) -> DataFrame:
    """Adds the twelve ratios; a missing column or value, or a zero denominator, gives 0."""
    have = set(wide.columns)

    def term(text: str):
        parts = text.split(" + ")
        return sum((F.col(p) for p in parts[1:]), F.col(parts[0])) if have >= set(parts) else None

    out = {}
    for name, (a, b) in RATIOS.items():
        x, y = term(a), term(b)
        out[name] = F.lit(0.0) if x is None or y is None else F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return wide.withColumns(out)


def with_daily(prices: DataFrame, daily: DataFrame, keys: tuple[str, ...] = ("ticker", "date")) -> DataFrame:
    """Prices with the daily fundamentals of their day, null where there are none; columns of daily that prices have too are left out."""
    extra = [c for c in daily.columns if c not in prices.columns]
    return prices.join(daily.select(*keys, *extra).dropDuplicates(list(keys)), list(keys), "left")
