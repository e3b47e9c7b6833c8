"""Measures that SQL does not state, against plain loops, and readers, writers and streams."""

import datetime as dt
import itertools
import json
import math
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_operators import bars, swing_by_hand, walk

from tidewater.functions import windows as w
from tidewater.operators import fundamentals, models, recursive, signals, universe
from tidewater.plans.catalog import technicals
from tidewater.sources import files
from tidewater.streaming import events


def plain_adaptive(x, n, reach):
    """Row by row, in the words of the definition."""
    out, last = [None] * len(x), None
    for i in range(len(x)):
        if i == n - 1 and len(x) > n:
            seed = x[:n]
            last = sum(seed) / n if all(v == v for v in seed) else "later"
            out[i] = last if last != "later" else None
        elif i >= n:
            if last == "later":
                last = 0.0
                continue
            window = x[i - n : i + 1]
            known = all(v == v for v in window)
            path = sum(abs(b - a) for a, b in itertools.pairwise(window)) if known else 0.0
            ratio = abs(window[-1] - window[0]) / path if path > 0 else 0.0
            past = reach[max(0, i - 119) : i + 1]
            if len(past) == 120 and all(v == v for v in past) and x[i] == x[i]:
                normal = reach[i] / (sum(past) / 120)
                fast, slow = 2 / (int(max(2, 5 - 3 * normal)) + 1), 2 / (int(max(20, 30 + 10 * normal)) + 1)
                last += (ratio * (fast - slow) + slow) ** 2 * (x[i] - last)
            out[i] = last
    return [math.nan if v is None or v == 0 else v for v in out]


@pytest.mark.parametrize("case", range(6))
def test_adaptive_mean(case):
    rng = np.random.default_rng(case)
    n = [400, 300, 9, 15, 350, 500][case]
    x = 100 + rng.normal(size=n).cumsum()
    if case == 1:
        x[:4] = np.nan
    if case == 4:
        x[rng.random(n) < 0.05] = np.nan
    reach = np.concatenate([np.full(min(n, 119), np.nan), rng.random(max(0, n - 119)) + 0.5])
    reach = np.where(np.arange(n) < 119, np.nan, reach)
    assert np.allclose(recursive.adaptive_mean(x, 10, reach), plain_adaptive(x.tolist(), 10, reach.tolist()), equal_nan=True)


def plain_swings(x, gap):
    out, last, taken = [], x[0], 0
    for i, v in enumerate(x):
        if i >= gap and i - taken >= gap and v >= max(x[i - gap : i]):
            taken, last = i, v
        out.append(last)
    return out


def test_swing_confirmation_by_hand():
    rng = np.random.default_rng(8)
    n = 900
    close = 100 + 20 * np.sin(np.arange(n) / 45) + rng.normal(0, 1, n)
    s = {"close": close, "high": close + rng.random(n), "low": close - rng.random(n), "trendScore": np.where(np.arange(n) < 130, np.nan, np.sin(np.arange(n) / 45) * rng.random(n)), "atr20": np.where(np.arange(n) < 119, np.nan, 1 + rng.random(n))}
    got = recursive.swing_confirmation(s)
    score, atr = s["trendScore"].tolist(), s["atr20"].tolist()
    top, bottom = plain_swings(s["high"].tolist(), 5), [-v for v in plain_swings((-s["low"]).tolist(), 5)]
    limit = np.nanpercentile(np.abs(score), 30)
    price, weak = [], []
    sign = [math.nan if v != v else float(np.sign(v)) for v in score]
    turned = [False] + [sign[i] != sign[i - 1] and sign[i - 1] != 0 for i in range(1, n)]
    turned[0] = True
    for i in range(n):
        sure = min(1.0, abs(score[i]))
        level = 0.382 + sure * 0.236 if score[i] == score[i] else math.nan
        band = atr[i] * (4 - 0.5 * sure) if score[i] == score[i] else math.nan
        price.append(top[i] - (top[i] - bottom[i]) * level - band if score[i] > 0 else bottom[i] + (top[i] - bottom[i]) * level + band)
        weak.append(abs(score[i]) < limit or (i >= 9 and any(turned[i - 9 : i + 1])))
    slow, fast = plain_adaptive(price, 20, atr), plain_adaptive(price, 10, atr)
    line = [a * (0.95 if x else 0.4) + b * (0.05 if x else 0.6) for a, b, x in zip(slow, fast, weak, strict=True)]
    assert np.allclose(got["retracementThreshold"], line, equal_nan=True)
    crossing = ["None"] + ["toDown" if line[i - 1] < close[i - 1] and line[i] > close[i] else "toUp" if line[i - 1] > close[i - 1] and line[i] < close[i] else "None" for i in range(1, n)]
    assert got["retracementThresholdCrossover"].tolist() == crossing and {"toUp", "toDown"} <= set(crossing)
    slopes = [math.nan] * 9 + [float(np.polyfit(range(10), line[i - 9 : i + 1], 1)[0]) if not np.isnan(line[i - 9 : i + 1]).any() else math.nan for i in range(9, n)]
    high, low = np.nanpercentile(slopes, [80, 20])
    at = [i for i in range(n) if crossing[i] != "None"]
    confirmed = ["None"] * n
    for a, b in zip(at, [*at[1:], n - 1], strict=True):
        if b - a >= 30:
            for i in range(a, b):
                if (crossing[a] == "toUp" and slopes[i] > high) or (crossing[a] == "toDown" and slopes[i] < low):
                    confirmed[i] = crossing[a]
                    break
    assert got["reversalConf"].tolist() == confirmed and set(confirmed) == {"None", "toUp", "toDown"}


@pytest.mark.parametrize("states", [1, 2, 3])
def test_kalman_states_are_the_least_squares_fit(states):
    """The filtered state is the last one of the most probable path of states, given all values so far."""
    rng = np.random.default_rng(states)
    z = 50 + rng.normal(size=12).cumsum()
    got = recursive.kalman_states({"close": z}, states)["kalmanStates"]
    move = np.eye(states) + np.eye(states, k=1)
    for t in range(1, z.size + 1):
        size = (t + 1) * states  # the state before the first row, then one for each
        rows, right = [], []
        block = lambda k: np.eye(size)[k * states : (k + 1) * states]  # noqa: B023, E731
        first = np.zeros(states)
        first[0] = z[0]
        rows.append(block(0) / 10)
        right.append(first / 10)
        for i in range(1, t + 1):
            rows.append((block(i) - move @ block(i - 1)) / 0.1)
            right.append(np.zeros(states))
            rows.append(block(i)[:1] / math.sqrt(15))
            right.append(z[i - 1 : i] / math.sqrt(15))
        x = np.linalg.lstsq(np.vstack(rows), np.concatenate(right), rcond=None)[0]
        assert got[t - 1] == pytest.approx(x[t * states], rel=1e-8)


def test_wavelet_by_matrices():
    """One level is an orthogonal matrix; details are drawn towards zero by the limit."""
    n = 16
    x = 100 + np.random.default_rng(3).normal(size=n).cumsum()
    low = recursive.DB6
    high = [(-1) ** i * low[11 - i] for i in range(12)]
    matrix = np.zeros((n, n))
    for i in range(n // 2):
        for j in range(12):
            matrix[i, (2 * i + j) % n] += low[j]
            matrix[n // 2 + i, (2 * i + j) % n] += high[j]
    assert np.allclose(matrix @ matrix.T, np.eye(n), atol=1e-10)
    both = matrix @ x
    d = both[n // 2 :]
    limit = 0.005 * x.max()
    both[n // 2 :] = [math.copysign(max(0.0, abs(v) - limit), v) for v in d]
    assert np.allclose(recursive.wavelet({"close": x}, share=0.005)["wavelet_db6"], matrix.T @ both)


def plain_z(x):
    n = 120 if len(x) <= 250 else 250
    r = pd.Series(x).rolling(n)
    sd = r.std()
    return ((pd.Series(x) - r.mean()) / sd.where(sd > 0)).to_numpy()


def plain_slope(x, n):
    return np.array([math.nan if i < n - 1 or np.isnan(x[i - n + 1 : i + 1]).any() else np.polyfit(range(n), x[i - n + 1 : i + 1], 1)[0] for i in range(len(x))])


def plain_clause(frame, feature, key, c):
    feature = c.get("feature", feature)
    x = frame[feature].to_numpy(float)

    def side(value, series):
        if isinstance(value, str) and value in frame:
            return frame[value].to_numpy(float)
        return np.full(len(frame), np.nanpercentile(series, int(re.match(r"\d+", value)[0])) if isinstance(value, str) else float(value))

    with np.errstate(invalid="ignore"):
        if key.startswith("threshold"):
            x = plain_slope(x, c["trend"]) if c.get("trend") else x
            x = plain_z(x) if c.get("zscored") else x
            out = np.ones(len(x), bool)
            if "above" in c:
                out &= x >= side(c["above"], x)
            if "below" in c:
                out &= x <= side(c["below"], x)
        elif key.startswith("crossover"):
            y = side(c.get("above", c.get("below")), x)
            a, b = np.append(np.nan, x[:-1]), np.append(np.nan, y[:-1])
            out = (x >= y) & (a <= b) if "above" in c else (x <= y) & (a >= b)
        elif key.startswith("failureSwing"):
            kind = "bottom" if "bottom" in c else "top"
            n = c[kind]
            out = np.array([i >= n - 1 and not np.isnan(x[i - n + 1 : i + 1]).any() and swing_by_hand(x[i - n + 1 : i + 1].tolist(), kind, c["thresh"]) for i in range(len(x))])
        else:
            f, g = plain_z(x), plain_z(frame[c["coFeature"]].to_numpy(float))
            if c.get("trend"):
                f, g = plain_slope(f, c["trend"]), plain_slope(g, c["trend"])
            gap = np.where(f > g if c.get("direction") == 1 else f < g, np.abs(f - g), np.nan)
            name = "above" if key.startswith("divergence") else "below"
            limit = np.nanpercentile(gap, int(re.match(r"\d+", c[name])[0])) if not np.isnan(gap).all() else math.nan
            out = gap >= limit if name == "above" else gap <= limit
    if "length" in c:
        out = np.array([i >= c["length"] - 1 and out[i - c["length"] + 1 : i + 1].all() for i in range(len(out))])
    if "currentTrend" in c:
        out = out & (frame["retracementTrend"].to_numpy() == c["currentTrend"])
    return out


def plain_signal(frame, feature, clauses):
    parts = []
    for key, c in clauses.items():
        one = plain_clause(frame, feature, key, c)
        if parts and key[-1].isdigit():
            parts[-1] = parts[-1] | one
        else:
            parts.append(one)
    return np.logical_and.reduce(parts)


@pytest.fixture(scope="module")
def technical(spark, tmp_path_factory):
    """Two tickers with every column that signals read, one of over 250 rows and one of fewer."""
    one = bars(spark, walk(520, 9), open=np.array(walk(520, 10)))
    df = technicals(one.unionByName(bars(spark, walk(240, 5), ticker=2, open=np.array(walk(240, 6)))))
    path = f"{tmp_path_factory.mktemp('technical')}/bars"
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_all_configured_signals_by_hand(technical):
    got = signals.compile_signals(technical).toPandas()
    fired = 0
    for _, own in got.groupby("ticker"):
        own = own.sort_values("date").reset_index(drop=True)
        for name, (feature, clauses) in signals.SIGNALS.items():
            want = plain_signal(own, feature, clauses)
            differ = np.flatnonzero(own[name].to_numpy(bool) != want)
            assert differ.size == 0, (name, differ[:5])
            fired += bool(want.any())
    assert fired > 40, "most signals stand somewhere"


def test_configured_signals_scored_and_backtested(spark, technical):
    listing = spark.createDataFrame([(1, "tech", "Large", "x"), (2, "tech", "Mid", "x")], "ticker long, sector string, cap string, exchange string")
    raw = signals.compile_signals(technical.join(listing, "ticker"))
    scored = signals.score(raw, list(signals.SIGNALS))
    results = {(r.ticker, r.signalName): r for r in signals.backtest(scored).collect()}
    assert len(results) == 2 * len(signals.SIGNALS)
    frame = raw.toPandas()
    for ticker, own in frame.groupby("ticker"):
        own = own.sort_values("date").reset_index(drop=True)
        for name in signals.SIGNALS:
            up = name.startswith("bullish")
            counts = dict.fromkeys(("reversalCount", "reversalSuccess", "reversalFailure", "continuationCount", "continuationSuccess", "continuationFailure"), 0)
            for i in np.flatnonzero(own[name]):
                seen = set(own.reversalConf[i : i + 61]) - {"None"}
                against = own.retracementTrend[i] == (-1 if up else 1)
                kind = "reversal" if against else "continuation"
                good = ("toUp" if up else "toDown") in seen if against else not seen
                counts[f"{kind}Count"] += 1
                counts[f"{kind}Success" if good else f"{kind}Failure"] += 1
            assert {c: results[ticker, f"{name}_sig"][c] for c in counts} == counts, name


def test_running_sums_give_the_sliding_windows(spark):
    x = [None if i % 37 == 5 else v for i, v in enumerate(walk(300, 2))]
    frame = bars(spark, [v or 0.0 for v in x]).withColumn("x", F.when(F.col("close") != 0, F.col("close")))
    rows = w.indexed(frame).select("date", w.slope("x", 12).alias("s"), w.zscore("x", 30).alias("z"), w.known("x", 30).alias("k")).orderBy("date").collect()
    y = np.array([math.nan if v is None else v for v in x])
    r = pd.Series(y).rolling(30)
    none = lambda v: math.nan if v is None else v
    assert np.allclose([none(v.s) for v in rows], plain_slope(y, 12), equal_nan=True)
    assert np.allclose([none(v.z) for v in rows], ((pd.Series(y) - r.mean()) / r.std()).to_numpy(), equal_nan=True)
    flat = bars(spark, [7.0] * 60)
    assert {v.z for v in flat.select(w.zscore("close", 30).alias("z")).collect()} == {None}


def test_clusters_of_fixed_points(spark):
    points = [(i, v + d, t + d) for i, (v, t, d) in enumerate((v, t, d) for v, t in ((70.0, 4.0), (20.0, 15.0), (45.0, 7.0)) for d in (-0.2, 0.0, 0.2))]
    out = {r.id: r.cluster_num for r in models.clusters(spark.createDataFrame(points, "id long, velocity double, travel_time double")).collect()}
    assert [out[i] for i in range(9)] == [2, 2, 2, 0, 0, 0, 1, 1, 1]


def test_negative_volumes_are_drawn_again(spark):
    drawn = spark.range(4000).select((F.lit(1.0) + 3.0 * F.sqrt(-2 * F.log(F.rand(1))) * F.cos(2 * math.pi * F.rand(2))).alias("x")).where("x >= 0").agg(F.avg(F.floor("x"))).first()[0]
    volumes = spark.createDataFrame([(float(i), 1.0, 3.0) for i in range(96)], "interval_index double, mean_volume double, stddev_volume double")
    assert models.REDRAWS == 64 and drawn > 1.5 and volumes.count() == 96


def test_deletes_and_purges(spark):
    old = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "ticker string, x int")
    assert sorted(r.ticker for r in universe.delete_where(old, F.col("x") > 2).collect()) == ["a", "b"]
    meta = spark.createDataFrame([("a", "deadTicker"), ("b", "active"), ("a", "deadTicker")], "ticker string, designation string")
    assert sorted(r.ticker for r in universe.purge(old, meta, ["ticker"]).collect()) == ["b", "c"]


def test_daily_fundamentals_join_on_days(spark):
    prices = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0)], "ticker string, date int, close double")
    daily = spark.createDataFrame([("a", 1, 9.0, 100.0), ("a", 1, 9.0, 100.0), ("b", 2, 8.0, 1.0)], "ticker string, date int, close double, marketCap double")
    assert sorted((r.date, r.close, r.marketCap) for r in fundamentals.with_daily(prices, daily).collect()) == [(1, 5.0, 100.0), (2, 6.0, None)]


def test_price_payloads(spark, tmp_path):
    (tmp_path / "ABC.json").write_text(json.dumps([{"date": "2024-01-02T00:00:00Z", "open": 1.00004, "high": 2, "low": 1, "close": 1.5, "volume": 10}, {"date": "2024-01-03", "close": None}]))
    rows = files.read_prices(spark, f"{tmp_path}/*.json").collect()
    assert [(r.ticker, r.date, r.open, r.close, r.splitFactor) for r in rows] == [("abc", dt.date(2024, 1, 2), 1.0, 1.5, 1.0)]


def test_intervals_in_one_scan(spark, tmp_path):
    one = spark.createDataFrame([("car", 50.0, 0)], files.VEHICLE)
    for name in ("dt_2024_06_01_00_15_00", "dt_2024_06_01_23_45_00", "other"):
        one.write.parquet(f"{tmp_path}/{name}")
    got = files.read_intervals(spark, f"{tmp_path}/dt_*")
    assert sorted(r.datetime for r in got.collect()) == [dt.datetime(2024, 6, 1, 0, 15), dt.datetime(2024, 6, 1, 23, 45)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_catalog_helpers(spark):
    spark.range(1).createOrReplaceTempView("dt_2024_06_01_00_00_00")
    assert files.interval_tables(spark) == ["dt_2024_06_01_00_00_00"]
    assert files.table_columns(spark, "dt_2024_06_01_00_00_00") == {"id": "bigint"} and files.table_columns(spark, "no_such_table") == {}
    spark.catalog.dropTempView("dt_2024_06_01_00_00_00")


def test_result_sets_come_back(spark, tmp_path):
    sets = {name: spark.createDataFrame([("a", i), ("b", i + 1)], "scenario string, n int") for i, name in enumerate(files.RESULTS)}
    files.write_result_sets(sets, str(tmp_path))
    for i, name in enumerate(files.RESULTS):
        assert sorted((r.scenario, r.n) for r in files.read_result_set(spark, str(tmp_path), name, "n int").collect()) == [("a", i), ("b", i + 1)]
    with pytest.raises(ValueError):
        files.write_result_sets({"other": sets["cluster_summary"]}, str(tmp_path))


def test_retries_wait_longer_each_time(caplog):
    waits, calls = [], []

    @files.logged
    @files.retrying(attempts=4, wait=1.0, sleep=waits.append)
    def call(fails):
        calls.append(1)
        if len(calls) <= fails:
            raise OSError
        return len(calls)

    with caplog.at_level("INFO"):
        assert call(3) == 4 and waits == [1.0, 2.0, 4.0]
    assert "call" in caplog.text
    calls.clear()
    with pytest.raises(OSError):
        call(9)


def test_compaction_and_stale_partitions(spark, tmp_path):
    spark.range(100).repartition(9).write.parquet(f"{tmp_path}/a")
    files.compact(spark, f"{tmp_path}/a", f"{tmp_path}/b", 2)
    assert spark.read.parquet(f"{tmp_path}/b").count() == 100 and len(list((tmp_path / "b").glob("*.parquet"))) == 2
    stored = spark.createDataFrame([("x", 1), ("y", 2)], "sector string, ticker long")
    assert [r.ticker for r in files.stale_partitions(stored, stored.where("ticker = 1"), ("sector", "ticker")).collect()] == [2]


def test_stream_keeps_the_latest_row(spark, tmp_path):
    schema = "k int, at long, v string"
    source = f"{tmp_path}/in"
    for rows in ([(1, 5, "a"), (2, 1, "x"), (1, 4, "late")], [(1, 3, "older"), (3, 1, "n")], [(2, 2, "y"), (2, 2, "x")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    events.upsert_stream(stream, f"{tmp_path}/out", ["k"], "at", f"{tmp_path}/check", buckets=4).awaitTermination(120)
    assert sorted((r.k, r.at, r.v) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 5, "a"), (2, 2, "y"), (3, 1, "n")]


def test_upsert_has_one_result_for_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a"), (1, "c"), (2, "z")], "k int, v string")
    new = spark.createDataFrame([(1, "d"), (1, "e")], "k int, v string")
    for parts in (1, 5):
        assert sorted((r.k, r.v) for r in universe.upsert(old.repartition(parts), new.repartition(parts), ["k"]).collect()) == [(1, "e"), (2, "z")]


@pytest.mark.parametrize(("last", "due"), [(None, True), (dt.date(2024, 5, 3), True), (dt.date(2024, 5, 10), False)])
def test_backtest_gate(last, due):
    assert signals.backtest_due(dt.date(2024, 5, 31), last) is due
    assert not signals.backtest_due(dt.date(2024, 5, 30), dt.date(2024, 1, 1)), "a Thursday"
