"""Operators that SQL does not state, and edge cases, on small series."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.functions import windows as w
from tidewater.operators import candles, features, fundamentals, indicators, models, recursive, signals, traffic, universe
from tidewater.sources import files
from tidewater.streaming import events


def bars(spark, close, ticker=1, **more):
    n = len(close)
    frame = pd.DataFrame({"ticker": ticker, "date": [dt.date(2000, 1, 1) + dt.timedelta(i) for i in range(n)], "close": close})
    frame["open"], frame["high"], frame["low"], frame["volume"] = frame.close, frame.close + 1, frame.close - 1, 100
    for c, v in more.items():
        frame[c] = v
    return spark.createDataFrame(frame)


def column(df, name):
    return [r[0] for r in df.orderBy("date").select(name).collect()]


def walk(n, seed=0):
    return np.round(100 + np.random.default_rng(seed).normal(0, 1, n).cumsum(), 2).tolist()


def test_series_too_short_are_null(spark):
    df = recursive.add(bars(spark, walk(10)), "ema", "atr", "rsi", "psar", "kama", "kalman", "wavelet")
    assert set(column(df, "ema5")) == {None} and set(column(df, "rsi14")) == {None} and set(column(df, "kama20")) == {None}
    assert column(df, "psar")[0] is None and column(df, "psar")[1] is not None
    assert None not in column(df, "kalmanClose")


def test_empty_table(spark):
    df = bars(spark, [1.0]).limit(0)
    assert recursive.add(df, "atr", "rsi").count() == 0
    assert indicators.cci(df).count() == 0
    assert candles.candles(df).count() == 0


def test_constant_price(spark):
    df = recursive.add(indicators.bollinger(bars(spark, [5.0] * 200)), "rsi", "macd", "adx")
    assert column(df, "bollingerRange20")[-1] == 0 and column(df, "rsi14")[-1] == 100 and abs(column(df, "macd")[-1]) < 1e-9


def test_rsi_by_hand(spark):
    close = walk(60, 3)
    step = np.diff(close)
    gain, loss = np.maximum(step, 0)[:14].mean(), np.maximum(-step, 0)[:14].mean()
    for d in step[14:]:
        gain, loss = (13 * gain + max(d, 0)) / 14, (13 * loss + max(-d, 0)) / 14
    assert column(recursive.add(bars(spark, close), "rsi"), "rsi14")[-1] == pytest.approx(100 - 100 / (1 + gain / loss))


def test_kalman_one_state_is_the_scalar_filter(spark):
    df = recursive.add(bars(spark, walk(80)), "kalman", "kalman_states")
    assert np.allclose(column(df, "kalmanClose"), column(df, "kalmanStates"))


def test_psar_follows_a_rise(spark):
    df = recursive.add(bars(spark, [float(x) for x in range(1, 40)]), "psar")
    assert all(s < c for s, c in zip(column(df, "psar")[2:], column(df, "close")[2:], strict=True))


def test_wavelet_without_threshold_gives_the_series_back():
    x = np.array(walk(64))
    assert np.allclose(recursive.wavelet({"close": x}, share=0.0)["wavelet_db6"], x)
    assert recursive.wavelet({"close": np.array(walk(61))})["wavelet_db6"].size == 61


def test_swings_keep_their_distance():
    peaks = np.flatnonzero(~np.isnan(recursive._swings(np.array(walk(300)), 5)))
    assert peaks.size and (np.diff(peaks) >= 5).all() and peaks[0] >= 5


def test_swing_confirmation_is_consistent(spark):
    n = 700
    close = (100 + 20 * np.sin(np.arange(n) / 60) + np.random.default_rng(2).normal(0, 0.5, n)).tolist()
    df = recursive.add(indicators.on_balance_volume(bars(spark, close)), "atr", "macd", "adx", "kama", "trend_score", "swing_confirmation")
    rows = df.orderBy("date").collect()
    assert {r.reversalConf for r in rows} <= {"None", "toUp", "toDown"}
    assert all(r.retracementTrend == (-1 if r.retracementThreshold is not None and r.retracementThreshold > r.close else 1) for r in rows)
    assert all(r.trendScore is None or -1 <= r.trendScore <= 1 for r in rows)


def swing_by_hand(y, kind, limit):
    if kind == "top":
        return swing_by_hand([-v for v in y], "bottom", -limit)
    low = min(y)
    if low > limit:
        return False
    rest = y[y.index(low) + 3 :]
    valleys = [rest[i] for i in range(len(rest) - 1) if rest[i] < rest[i + 1] and rest[i] < (rest[i - 1] if i else y[-1])]
    return bool(valleys) and y[-2] == min(valleys)


@pytest.mark.parametrize("kind", ["bottom", "top"])
def test_failure_swing(spark, kind):
    rng = np.random.default_rng(4)
    rows = [[float(v) for v in rng.integers(0, 12, 8)] for _ in range(300)]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x array<double>").select("i", signals.failure_swing(F.col("x"), kind, 5).alias("f")).orderBy("i").collect()
    expected = [swing_by_hand(r, kind, 5) for r in rows]
    assert [bool(r.f) for r in got] == expected and any(expected)


def test_all_configured_signals_compile(spark):
    from tidewater.plans.catalog import technicals

    df = signals.compile_signals(technicals(bars(spark, walk(400, 9), open=np.array(walk(400, 10)))))
    assert len(signals.SIGNALS) == 47 and set(signals.SIGNALS) <= set(df.columns)
    assert all(v is not None for v in df.select(*signals.SIGNALS).orderBy("date").collect()[-1]) if "date" in df.columns else True


def test_candles_by_hand(spark):
    df = bars(spark, [10.0, 8.0, 12.0], open=[9.0, 10.0, 7.0])
    df = df.withColumn("high", F.greatest("open", "close")).withColumn("low", F.least("open", "close"))
    assert column(candles.candles(df), "bullishEngulfing") == [False, False, True]
    assert len(candles.PATTERNS) == 34


def test_rolling_over_known_values_squeezes_nulls(spark):
    df = bars(spark, [1.0, 2.0, 3.0, 4.0, 5.0]).withColumn("x", F.when(F.col("close") != 3, F.col("close")))
    assert column(features.roll(df, ["x"], [2], ["mean"]), "x_mean_2") == [None, 1.5, None, 3.0, 4.5]


def test_scales_without_spread(spark):
    df = bars(spark, [4.0] * 5)
    for kind in ("Robust", "MinMax", "Standard", "PowerTransformer"):
        assert column(features.scale(df, ["close"], kind), "close") == [0.0] * 5
    with pytest.raises(ValueError):
        features.scale(df, ["close"], "other")


def test_power_scale_is_standard_and_monotone():
    x = np.random.default_rng(1).lognormal(0, 1, 500)
    y = features.power_scale(x)
    assert abs(y.mean()) < 1e-9 and abs(y.std() - 1) < 1e-9 and (np.diff(y[np.argsort(x)]) >= 0).all()
    skew = lambda v: ((v - v.mean()) ** 3).mean() / v.std() ** 3
    assert abs(skew(y)) < 0.3 < abs(skew(x))


def test_split_round_trip(spark):
    df = bars(spark, [100.0, 102.0, 51.0, 52.0], splitFactor=[1.0, 1.0, 2.0, 1.0])
    adjusted = indicators.split_adjust(df)
    assert column(adjusted, "close") == [50.0, 51.0, 51.0, 52.0] and column(adjusted, "volume") == [200, 200, 100, 100]
    assert column(indicators.split_restore(adjusted), "close") == [100.0, 102.0, 51.0, 52.0]


def test_activity_labels(spark):
    rich, poor = [1000.0] * 200, [1.0] * 200
    frames = [bars(spark, c, t) for t, c in enumerate([rich, poor, rich[:50], rich + poor, poor + rich])]
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    got = {r.ticker: r for r in indicators.activity_check(df).collect()}
    assert [got[i].designation for i in range(5)] == ["active", "deadTicker", "notEnoughData", "recentDatesInactive", "active"]
    assert got[3].keep_to is not None and got[4].keep_from is not None and got[0].passes


def test_ratios_with_missing_inputs(spark):
    df = spark.createDataFrame([(1, 10.0, 0.0), (2, 10.0, 5.0)], "ticker int, netinc double, revenue double")
    rows = fundamentals.ratios(df).orderBy("ticker").collect()
    assert rows[0].netMargin == 0 and rows[1].netMargin == 2 and rows[1].quickRatio == 0


def test_upsert_and_insert_of_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, universe.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, universe.insert_if_absent(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_simulation_repeats(spark):
    a, b = (traffic.simulate(spark, "2024-06-01", 1).agg(F.count("*"), F.sum("velocity"), F.min("velocity")).first() for _ in range(2))
    assert a == b and a[0] > 20_000 and a[2] > 0


def test_forecast_is_seeded_and_ordered(spark):
    rows = traffic.features(traffic.simulate(spark, "2024-06-03", 1).withColumn("id", F.xxhash64("datetime", "velocity")).withColumn("travel_time", 300 / F.col("velocity")))
    rows = models.clusters(rows.where("interval_index >= 32 and interval_index < 36").cache())
    speeds = [r.v for r in rows.groupBy("cluster_num").agg(F.avg("velocity").alias("v")).orderBy("cluster_num").collect()]
    assert speeds == sorted(speeds) and len(speeds) == 3
    threshold = float(traffic.lower_share_threshold(rows).first()[0])
    make = lambda: traffic.kpis(models.forecast(traffic.volume_distribution(rows), traffic.shares(rows), traffic.log_time(rows.where("cluster_num = 0")), models.fit_speed(rows, threshold), models.fit_accidents(rows.withColumn("accident", F.when(F.col("id") % 50 == 0, 1).otherwise(0))), days=1)).orderBy("scenario").collect()
    first = make()
    assert len(first) == 5 and first == make()


def test_threshold_is_the_least_of_percent_rank(spark):
    x = np.random.default_rng(0).integers(0, 40, 501)
    got = traffic.lower_share_threshold(spark.createDataFrame(pd.DataFrame({"travel_time": x.astype(float)}))).first()[0]
    rank = (pd.Series(x).rank(method="min") - 1) / (x.size - 1)
    assert got == x[rank >= 0.2].min()


def test_rate_limit_waits():
    now = [0.0]
    limit = files.Limit(2, 10, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    times = []
    for _ in range(5):
        limit.wait()
        times.append(now[0])
    assert times == [0, 0, 10, 10, 20]


def test_partitioned_write_replaces_only_its_partitions(spark, tmp_path):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "exchange string, v int")
    files.write_partitioned(a, str(tmp_path / "t"), ("exchange",))
    files.write_partitioned(a.where("exchange = 'x'").withColumn("v", F.lit(9)), str(tmp_path / "t"), ("exchange",))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("exchange", "v").collect()} == {("x", 9), ("y", 2)}


def test_traffic_csv_round_trip(spark, tmp_path):
    rows = traffic.simulate(spark, "2024-06-01", 1).limit(50).select(F.lit(1).cast("long").alias("id"), "datetime", "vehicle_type", F.lit(0).alias("vehicle_encoding"), "velocity", F.lit(1.0).alias("travel_time"), "accident", F.lit("s").alias("scenario"))
    files.write_days(rows, str(tmp_path / "d"))
    back = files.read_traffic(spark, str(tmp_path / "d/*/*"))
    assert back.count() == 50 and back.where("velocity is null").count() == 0


def test_append_rows_keeps_keys(spark):
    spark.sql("DROP TABLE IF EXISTS kept")
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "k int, v int")
    files.append_rows(spark, "kept", df, ["k"])
    files.append_rows(spark, "kept", spark.createDataFrame([(2, 5), (3, 5)], "k int, v int"), ["k"])
    assert sorted(r.k for r in spark.table("kept").collect()) == [1, 2, 3]


def test_stream_counts_intervals(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, 0, i), 1, "view", 50.0 + i, "{}") for i in range(40)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(str(tmp_path / "in"))
    stream = events.interval_volume(events.read_events(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("volumes").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.volume for r in spark.table("volumes").orderBy("datetime").collect()] == [15, 15, 10]


def test_held_counts_rows(spark):
    df = bars(spark, [1.0, 2.0, 2.0, 1.0])
    assert column(df.withColumn("h", w.held(F.col("close") > 1, 2)), "h") == [False, False, True, False]
