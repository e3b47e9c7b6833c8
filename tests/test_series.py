"""The configured signals in one pass over bars against the same measures as Columns."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.operators import series, signals
from tidewater.plans import catalog


def walk(n, seed):
    return np.round(100 + np.random.default_rng(seed).normal(0, 1, n).cumsum(), 2)


def bars(spark):
    """Tickers of over 250 rows, of fewer, of some with unknown prices, of a stretch of equal prices without trade, of a few rows, of one."""
    frames = []
    for ticker, n in enumerate((520, 240, 400, 300, 15, 1), 1):
        close, start = walk(n, ticker), walk(n, 50 + ticker)
        if ticker == 4:
            close[60:130] = start[60:130] = 100.0
        f = pd.DataFrame({"ticker": ticker, "date": [dt.date(2000, 1, 1) + dt.timedelta(i) for i in range(n)], "close": close, "open": start})
        f["high"], f["low"] = f[["open", "close"]].max(axis=1) + 0.5, f[["open", "close"]].min(axis=1) - 0.5
        f["volume"] = np.where((np.arange(n) >= 60) & (np.arange(n) < 130) & (ticker == 4), 0, 100 + np.arange(n) % 7)
        frames.append(f.sample(frac=1, random_state=1))
    df = spark.createDataFrame(pd.concat(frames)).withColumn("sector", F.concat(F.lit("s"), "ticker"))
    unknown = (F.col("ticker") == 3) & (F.dayofyear("date") % 97 == 5)
    return df.withColumns({c: F.when(~unknown, F.col(c)) for c in ("open", "high", "low", "close")})


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bars"))
    bars(spark).repartition(3).write.mode("overwrite").parquet(path)
    df = spark.read.parquet(path)
    keep = tuple(c for c in catalog.technicals(df).columns if c not in (*df.columns, "kama20"))
    order = ["ticker", "date"]
    columns = signals.compile_signals(catalog.technicals(df)).toPandas().sort_values(order).reset_index(drop=True)
    return columns, series.configured(df, keep).toPandas().sort_values(order).reset_index(drop=True), keep


def test_measures_of_the_pass_are_those_of_the_columns(both):
    columns, own, keep = both
    assert len(own) == len(columns) == 1476 and (own.sector == columns.sector).all()
    for c in keep:
        if own[c].dtype == object:
            assert (own[c] == columns[c]).all(), c
        else:
            assert np.allclose(own[c].to_numpy(float), columns[c].to_numpy(float), rtol=1e-9, atol=1e-9, equal_nan=True), c


def test_signals_of_the_pass_are_those_of_the_columns(both):
    columns, own, _ = both
    differing = {c: int((own[c].astype(bool) != columns[c].astype(bool)).sum()) for c in signals.SIGNALS}
    assert not any(differing.values()), differing
    assert not own[list(signals.SIGNALS)].isna().any(axis=None) and sum(own[c].any() for c in signals.SIGNALS) > 40


def test_no_wide_windows(spark):
    """A plan of windows for each layer moves every column once for each of them."""
    d = "/root/testdata/sf0.001"
    plan = lambda name: catalog.QUERIES[name](spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan("sig_all_configured").count("Window [") == 0
    assert plan("signals_backtest").count("Window [") <= 4
    assert plan("signals_total_score").count("Window [") <= 1
