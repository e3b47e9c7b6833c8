"""Feature engineering for each ticker: scales, rolling statistics over known values, lags."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w

STATISTICS = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max, "sum": F.sum}


def _safe(spread: Column) -> Column:
    return F.when(spread == 0, 1.0).otherwise(spread)


def scaled(x: str, kind: str, over: Window) -> Column:
    """A column scaled over its group; a group without spread is only centred."""
    c = F.col(x)
    kind = kind.lower()
    if kind == "standard":
        return (c - F.avg(c).over(over)) / _safe(F.stddev_pop(c).over(over))
    if kind == "minmax":
        low, high = F.min(c).over(over), F.max(c).over(over)
        return (c - low) / _safe(high - low)
    if kind == "maxabs":
        return c / _safe(F.max(F.abs(c)).over(over))
    if kind == "robust":
        p = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(over)
        return (c - p[1]) / _safe(p[2] - p[0])
    if kind in ("quantile", "quantiletransformer"):
        # place among the known values, ties in the middle, from 0 to 1
        n = F.count(c).over(over)
        rank = F.rank().over(Window.partitionBy(*_partition(over)).orderBy(c.asc_nulls_last()))
        same = F.count(c).over(Window.partitionBy(*_partition(over), c))
        return F.when(c.isNotNull(), F.when(n == 1, 0.0).otherwise((rank - 1 + (same - 1) / 2) / (n - 1)))
    raise ValueError(f"unknown scale {kind}")


def _partition(over) -> list[Column]:
    return getattr(over, "_names", [F.col(w.KEY)])


def scale(df: DataFrame, columns: list[str], kind: str = "robust", by_era: bool = False) -> DataFrame:
    """Scales columns over each ticker, or over each ticker and era: standard, minmax, maxabs, robust, quantile or power."""
    names = [w.KEY]
    if by_era:
        df = df.withColumn("_era", w.era())
        names.append("_era")
    if kind.lower() in ("power", "powertransformer"):
        out = _power(df, columns, names)
    else:
        over = Window.partitionBy(*names)
        over._names = [F.col(n) for n in names]
        out = df.withColumns({c: scaled(c, kind, over) for c in columns})
    return out.drop("_era")


def yeo_johnson(x: np.ndarray, lam: float) -> np.ndarray:
    out = np.empty_like(x)
    up = x >= 0
    out[up] = np.log1p(x[up]) if abs(lam) < 1e-12 else ((x[up] + 1) ** lam - 1) / lam
    out[~up] = -np.log1p(-x[~up]) if abs(lam - 2) < 1e-12 else -((1 - x[~up]) ** (2 - lam) - 1) / (2 - lam)
    return out


def _likelihood(x: np.ndarray, lam: float) -> float:
    y = yeo_johnson(x, lam)
    spread = y.var()
    return -np.inf if not spread > 0 else -x.size / 2 * np.log(spread) + (lam - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x)))


def power_scale(x: np.ndarray, low: float = -4.0, high: float = 4.0, rounds: int = 80) -> np.ndarray:
    """Yeo-Johnson transform of greatest likelihood (golden section search), then standard scale; NaN stays."""
    known = x[~np.isnan(x)]
    if known.size < 2 or known.std() == 0:
        return x - (known.mean() if known.size else 0.0)
    ratio = (np.sqrt(5) - 1) / 2
    a, b = low, high
    for _ in range(rounds):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        if _likelihood(known, c) > _likelihood(known, d):
            b = d
        else:
            a = c
    out = x.copy()
    y = yeo_johnson(known, (a + b) / 2)
    out[~np.isnan(x)] = (y - y.mean()) / (y.std() or 1.0)
    return out


def _power(df: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        for c in columns:
            frame[c] = power_scale(frame[c].to_numpy(float))
        return frame

    typed = df.withColumns({c: F.col(c).cast("double") for c in columns})
    out = typed.groupBy(*names).applyInPandas(run, typed.schema)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def roll(df: DataFrame, columns: list[str], windows: list[int], statistics: list[str] | None = None) -> DataFrame:
    """Adds {column}_{statistic}_{n} over the last n known values."""
    for c in columns:
        for n in windows:
            df = w.rolling_known(df, c, {f"{c}_{s}_{n}": STATISTICS[s] for s in statistics or ["mean", "std", "min", "max"]}, n)
    return df


def lags(df: DataFrame, columns: list[str], steps: list[int] | None = None) -> DataFrame:
    """Adds {column}_lagged_{n}."""
    return df.withColumns({f"{c}_lagged_{n}": w.lag(c, n) for c in columns for n in steps or [1, 2, 3, 5]})
