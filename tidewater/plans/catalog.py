"""The queries: one for each operator, over the star-schema tables, each with SQL for comparison where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar
from ..functions import windows as w
from ..operators import breadth, candles, features, fundamentals, indicators, models, recursive, series, signals, traffic, universe
from ..sources import views
from . import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, f: Query, oracle: str | None = None) -> None:
    QUERIES[name] = f
    if oracle is not None:
        ORACLES[name] = oracle


def _rounded(df: DataFrame, columns: str, keys: str = "ticker date", digits: int = 4) -> DataFrame:
    return df.select(*keys.split(), *((F.round(F.col(c) + sql.NUDGE, digits) + F.lit(0.0)).alias(c) for c in columns.split()))


def _on_bars(name: str, columns: str, build: Callable[[DataFrame], DataFrame], relation: str | None = None, digits: int = 4) -> None:
    """A query of rounded columns over bars."""
    _query(name, lambda spark, d: _rounded(build(views.bars(spark, d)), columns, digits=digits), None if relation is None else sql.out(columns, relation, digits=digits))


# --- scans
_query("bars_daily", lambda spark, d: _rounded(views.bars(spark, d), "open high low close volume"), sql.out("open high low close volume", "bars"))
_query("listing_scan", lambda spark, d: views.listing(spark, d), f"WITH {sql.LISTING} SELECT * FROM listing")
_query(
    "interval_scan", lambda spark, d: views.traffic(spark, d).groupBy("datetime").agg(F.count("*").alias("volume")),
    f"WITH {sql.TRAFFIC} SELECT datetime, count(*) AS volume FROM traffic GROUP BY datetime",
)

# --- breadth
_BREADTH = """daily AS (SELECT date, count(*) FILTER (close > before) AS advances, count(*) FILTER (close < before) AS declines, count(*) FILTER (close = before) AS unchanged,
  CAST(coalesce(sum(volume) FILTER (close > before), 0) AS BIGINT) AS advancingVolume, CAST(coalesce(sum(volume) FILTER (close < before), 0) AS BIGINT) AS decliningVolume,
  CAST(coalesce(sum(volume) FILTER (close = before), 0) AS BIGINT) AS unchangedVolume, count(*) FILTER (close >= top) AS newHighs, count(*) FILTER (close <= bottom) AS newLows
  FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS before, max(close) OVER (PARTITION BY ticker ORDER BY date) AS top, min(close) OVER (PARTITION BY ticker ORDER BY date) AS bottom FROM bars) GROUP BY date)"""
_DATES = "(ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return breadth.measures(breadth.counters(views.bars(spark, d)))


_query("breadth_counters", lambda spark, d: breadth.counters(views.bars(spark, d)), f"WITH {sql.BARS}, {_BREADTH} SELECT * FROM daily")


def _breadth(name: str, column: str, expression: str, build=_daily) -> None:
    _query(name, lambda spark, d: _rounded(build(spark, d), column, "date", 6), f"WITH {sql.BARS}, {_BREADTH} SELECT date, round(CAST({expression} AS DOUBLE) + {sql.NUDGE!r}, 6) + CAST(0 AS DOUBLE) AS {column} FROM (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i, sum(advances - declines) OVER {_DATES} AS ad FROM daily)")


_SHARE = "(newHighs::DOUBLE / nullif(newHighs + newLows, 0))"
_breadth("breadth_ad_line", "adLine", "ad")
_breadth("breadth_high_low_index", "newHighLowIndex", f"CASE WHEN count({_SHARE}) OVER (ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) = 10 THEN avg({_SHARE}) OVER (ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END")
_breadth("breadth_trin", "trin", "(advances::DOUBLE / nullif(declines, 0)) / nullif(advancingVolume + decliningVolume, 0)")
_breadth("breadth_obv", "breadthOBV", f"sum(advancingVolume::DOUBLE / nullif(decliningVolume, 0)) OVER {_DATES}")
_query(
    "breadth_mcclellan", lambda spark, d: _rounded(breadth.mcclellan(_daily(spark, d)), "mcclellan", "date"),
    f"""WITH RECURSIVE {sql.BARS}, {_BREADTH}, line AS (SELECT date, row_number() OVER (ORDER BY date) AS n, CAST(sum(advances - declines) OVER {_DATES} AS DOUBLE) AS ad FROM daily),
    r AS (SELECT n, date, ad AS a, 1.0::DOUBLE AS wa, ad AS b, 1.0::DOUBLE AS wb FROM line WHERE n = 1
      UNION ALL SELECT l.n, l.date, r.a * 0.9 + l.ad, r.wa * 0.9 + 1, r.b * 0.95 + l.ad, r.wb * 0.95 + 1 FROM r JOIN line AS l ON l.n = r.n + 1)
    SELECT date, round(a / wa - b / wb + {sql.NUDGE!r}, 4) + CAST(0 AS DOUBLE) AS mcclellan FROM r""",
)

# --- windows
_on_bars("roll_mean", "mean_20", lambda b: b.withColumn("mean_20", w.mean("close", 20)), f"(SELECT *, {sql.roll('avg', 'close', 20)} AS mean_20 FROM bars)")
_on_bars("roll_std_samp", "std_20", lambda b: b.withColumn("std_20", w.deviation("close", 20)), f"(SELECT *, {sql.roll('stddev_samp', 'close', 20)} AS std_20 FROM bars)")
_GAPPED = "(SELECT *, CASE WHEN i % 7 <> 3 THEN close END AS x FROM bars)"


def _gapped(b: DataFrame) -> DataFrame:
    return w.indexed(b).withColumn("x", F.when(F.col("row_index") % 7 != 3, F.col("close")))


_on_bars(
    "roll_std_pop_nonnull", "x_std_10",
    lambda b: features.roll(_gapped(b), ["x"], [10], ["std"]),
    f"(SELECT *, CASE WHEN x IS NOT NULL AND count(x) OVER k = 10 THEN stddev_pop(x) OVER k END AS x_std_10 FROM {_GAPPED} WINDOW k AS (PARTITION BY ticker, x IS NULL ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))",
)
_on_bars("roll_min_max", "low_20 high_20", lambda b: b.withColumn("low_20", w.low("low", 20)).withColumn("high_20", w.high("high", 20)), f"(SELECT *, {sql.roll('min', 'low', 20)} AS low_20, {sql.roll('max', 'high', 20)} AS high_20 FROM bars)")
_on_bars("roll_sum", "sum_10", lambda b: b.withColumn("sum_10", w.total("volume", 10)), f"(SELECT *, {sql.roll('sum', 'volume', 10)} AS sum_10 FROM bars)")
_on_bars("lag_features", "back ahead", lambda b: b.withColumn("back", w.lag("close", 3)).withColumn("ahead", w.lag("close", -2)), f"(SELECT *, {sql.lag('close', 3)} AS back, lead(close, 2) OVER ({sql.ORDER}) AS ahead FROM bars)")
_on_bars("ffill", "filled", lambda b: _gapped(b).withColumn("filled", w.forward_fill("x")), f"(SELECT *, last_value(x IGNORE NULLS) OVER {sql._RUN} AS filled FROM {_GAPPED})")
_on_bars("cumulative_sum", "total", lambda b: b.withColumn("total", w.cumulative("volume")), f"(SELECT *, sum(volume) OVER {sql._RUN} AS total FROM bars)")
_on_bars("era_bucket", "era", lambda b: b.withColumn("era", w.era()), "(SELECT *, " + " + ".join(f"CAST(date >= DATE '{s}' AS INTEGER)" for s in w.ERA_STARTS) + " AS era FROM bars)")
_on_bars("zscore_250", "z", lambda b: b.withColumn("z", w.rolling_zscore("close")), f"(SELECT *, {sql.rolling_z('close')} AS z FROM bars)")
_on_bars("slope_10", "s", lambda b: w.indexed(b).withColumn("s", w.slope("close", 10)), f"(SELECT *, {sql.slope('close', 10)} AS s FROM bars)")
_on_bars("percentile_over", "p75", lambda b: b.withColumn("p75", w.percentile("close", 75)), f"(SELECT *, {sql.percentile('close', 75)} AS p75 FROM bars)")
_on_bars("held_rows", "h", lambda b: b.withColumn("h", w.held(F.col("close") > F.col("open"), 2).cast("int")), f"(SELECT *, CAST(coalesce(sum(CAST(coalesce(close > open, false) AS INTEGER)) OVER {sql.frame(2)} = 2, false) AS INTEGER) AS h FROM bars)")
_query(
    "gaps_islands", lambda spark, d: views.bars(spark, d).withColumn("up", F.col("close") > F.col("open")).withColumn("run", w.islands(F.col("up"))).groupBy("ticker", "run").agg(F.count("*").alias("rows"), F.first("up").alias("up")).select("ticker", F.col("run").cast("long"), "rows", "up"),
    f"WITH {sql.BARS} SELECT ticker, CAST(run AS BIGINT) AS run, count(*) AS rows, any_value(up) AS up FROM (SELECT *, sum(CASE WHEN up = p THEN 0 ELSE 1 END) OVER {sql._RUN} AS run FROM (SELECT *, lag(up) OVER ({sql.ORDER}) AS p FROM (SELECT *, close > open AS up FROM bars))) GROUP BY ticker, run",
)
_query(
    "weighted_mean", lambda spark, d: _rounded(views.bars(spark, d).groupBy("ticker").agg(w.weighted_mean("close", "volume").alias("price")), "price", "ticker"),
    sql.out("price", "(SELECT ticker, sum(close * volume) / sum(volume) AS price FROM bars GROUP BY ticker)", keys="ticker"),
)

# --- indicators by windows
_on_bars(
    "price_ceiling_floor", "priceChange priceCeiling priceFloor", indicators.price_ceilings,
    "(SELECT *, b + quantile_cont(priceChange, 0.99) OVER (PARTITION BY ticker, e) AS priceCeiling, b + quantile_cont(priceChange, 0.01) OVER (PARTITION BY ticker, e) AS priceFloor FROM (SELECT *, close - b AS priceChange FROM (SELECT *, lag(close) OVER (PARTITION BY ticker, e ORDER BY date) AS b FROM (SELECT *, "
    + " + ".join(f"CAST(date >= DATE '{s}' AS INTEGER)" for s in w.ERA_STARTS) + " AS e FROM bars))))",
)
_DEMAND = f"""(SELECT *, CASE WHEN move = 0 AND volume > 0 THEN 0.0 WHEN abs(bp) > abs(sp) THEN sp / nullif(bp, 0) ELSE bp / nullif(sp, 0) END AS demandRaw FROM (
  SELECT *, CASE WHEN close > open THEN volume::DOUBLE ELSE volume / nullif(move, 0) END AS bp, CASE WHEN close > open THEN volume / nullif(move, 0) ELSE volume::DOUBLE END AS sp FROM (
    SELECT *, (close - open) / nullif(open, 0) * (3 * close / nullif({sql.roll('avg', 'rng', 10)}, 0)) AS move FROM (SELECT *, {sql.roll('max', 'high', 2)} - {sql.roll('min', 'low', 2)} AS rng FROM bars))))"""
_on_bars("demand_pressure", "demandRaw", indicators.demand_pressure, _DEMAND)
_on_bars("demand_index", "demandIndex", lambda b: recursive.add(indicators.demand_pressure(b), "demand_index"), f"(SELECT *, {sql.ewm('demandRaw', 2 / 11)} AS demandIndex FROM {_DEMAND})")


def _far(f: str, x: str) -> str:
    far = f"(CASE WHEN n BETWEEN 120 AND 250 THEN {sql.roll(f, x, 120)} WHEN n > 250 THEN {sql.roll(f, x, 250)} END)"
    return f"abs(close - {far}) / nullif((close + {far}) / 2, 0) * 100"


_COUNTED = "(SELECT *, count(*) OVER (PARTITION BY ticker) AS n FROM bars)"
_on_bars("pct_from_max", "percentDiffMax", indicators.extremes_distance, f"(SELECT *, {_far('max', 'high')} AS percentDiffMax FROM {_COUNTED})")
_on_bars("pct_from_min", "percentDiffMin", indicators.extremes_distance, f"(SELECT *, {_far('min', 'low')} AS percentDiffMin FROM {_COUNTED})")
_on_bars(
    "aroon_20", "aroon20", indicators.aroon,
    f"(SELECT *, CASE WHEN len(hs) = 20 THEN 100.0 * ((20 - list_position(ls, list_min(ls))) - (20 - list_position(hs, list_max(hs)))) / 20 END AS aroon20 FROM (SELECT *, list(high) OVER {sql.frame(20)} AS hs, list(low) OVER {sql.frame(20)} AS ls FROM bars))",
)
_on_bars(
    "cci_20", "cci20 cci20_ma14", indicators.cci,
    f"(SELECT *, {sql.roll('sum', 'cci20', 14)} / 14 AS cci20_ma14 FROM (SELECT *, (tp - m) / nullif(0.015 * list_sum(list_transform(ts, lambda x: abs(x - m))) / 20, 0) AS cci20 FROM (SELECT *, {sql.roll('avg', 'tp', 20)} AS m, list(tp) OVER {sql.frame(20)} AS ts FROM (SELECT *, (high + low + close) / 3 AS tp FROM bars))))",
)
_on_bars("stdev_pct_20", "STDevPercent20", indicators.deviation_percent, f"(SELECT *, {sql.roll('stddev_samp', 'close', 20)} / {sql.roll('avg', 'close', 20)} * 100 AS STDevPercent20 FROM bars)")
_M, _S = sql.roll("avg", "close", 20), sql.roll("stddev_samp", "close", 20)
_on_bars("bollinger_20", "bollingerSMA20 bollingerUpper20 bollingerLower20 bollingerRange20", indicators.bollinger, f"(SELECT *, {_M} AS bollingerSMA20, {_M} + 2 * {_S} AS bollingerUpper20, {_M} - 2 * {_S} AS bollingerLower20, 4 * {_S} AS bollingerRange20 FROM bars)")
_ROCS = ", ".join(f"(close - {sql.lag('close', r)}) / nullif({sql.lag('close', r)}, 0) * 100 AS roc{r}" for r, _, _ in indicators.KST)
_KST = f"(SELECT *, {' + '.join(f'{sql.roll("avg", f"roc{r}", s)} * {k}' for r, s, k in indicators.KST)} AS kst FROM (SELECT *, {_ROCS} FROM bars))"
_on_bars("kst", "kst kstSig", indicators.kst, f"(SELECT *, {sql.roll('avg', 'kst', 9)} AS kstSig FROM {_KST})")
_WILLIAMS = f"(SELECT *, ({sql.roll('max', 'high', 14)} - close) / nullif({sql.roll('max', 'high', 14)} - {sql.roll('min', 'low', 14)}, 0) * -100 AS williamsR14 FROM bars)"
_on_bars("williams_r_14", "williamsR14", indicators.williams_r, _WILLIAMS)
_STOCHASTIC = f"(SELECT *, {sql.roll('avg', 'stochasticK20', 3)} AS stochasticD20 FROM (SELECT *, (close - {sql.roll('min', 'low', 20)}) / nullif({sql.roll('max', 'high', 20)} - {sql.roll('min', 'low', 20)}, 0) * 100 AS stochasticK20 FROM bars))"
_on_bars("stochastic_20", "stochasticK20 stochasticD20", indicators.stochastic, _STOCHASTIC)
_on_bars("obv_10", "OBV", indicators.on_balance_volume, f"(SELECT *, {sql.roll('sum', 'sv', 10)} AS OBV FROM (SELECT *, coalesce(sign(close - {sql.lag('close')}), 0) * volume AS sv FROM bars))")


def _trend_sql() -> str:
    lines = ", ".join(f"CASE WHEN n >= {n + 20} THEN {sql.slope('z', n)} END AS {name}TrendLine" for name, n in indicators.TRENDS.items())
    classes = ", ".join(f"CASE WHEN n < {n + 20} THEN NULL WHEN {name}TrendLine >= {sql.percentile(name + 'TrendLine', 75)} THEN 1 WHEN {name}TrendLine <= {sql.percentile(name + 'TrendLine', 25)} THEN -1 ELSE 0 END AS {name}Trend" for name, n in indicators.TRENDS.items())
    return f"(SELECT *, twoWeekTrendLine AS prevailingTrendLine, twoWeekTrend AS prevailingTrend FROM (SELECT *, {classes} FROM (SELECT *, {lines} FROM (SELECT *, {sql.rolling_z('close')} AS z, count(*) OVER (PARTITION BY ticker) AS n FROM bars))))"


_on_bars("trend_lines", " ".join(f"{n}TrendLine {n}Trend" for n in indicators.TRENDS) + " prevailingTrendLine prevailingTrend", lambda b: indicators.trend_lines(b, "close"), _trend_sql())


def _with_splits(b: DataFrame) -> DataFrame:
    """Bars with made-up splits: a factor of 2 on every 97th row, confirmed where the close halves about."""
    b = w.indexed(b)
    return b.withColumn("splitFactor", F.when(F.col("row_index") % 97 == 96, F.when(F.col("row_index") % 2 == 0, 2.0).otherwise(1.05)).otherwise(1.0)).drop("row_index")


_SPLITS = "(SELECT *, CASE WHEN i % 97 = 96 THEN CASE WHEN i % 2 = 0 THEN 2.0 ELSE 1.05 END ELSE 1.0 END AS splitFactor FROM bars)"
_LATER = f"({sql.ORDER} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
_on_bars(
    "split_adjust", "open high low close volume", lambda b: indicators.split_adjust(_with_splits(b), places=None),
    f"(SELECT ticker, date, open / l AS open, high / l AS high, low / l AS low, close / l AS close, round(volume * l) AS volume FROM (SELECT *, coalesce(product(f) OVER {_LATER}, 1) AS l FROM (SELECT *, CASE WHEN splitFactor <> 1 AND close > p * 0.75 AND close < p * 1.25 THEN splitFactor END AS f FROM (SELECT *, {sql.lag('close')} / splitFactor AS p FROM {_SPLITS}))))",
)
_on_bars("split_restore", "close volume", lambda b: indicators.split_restore(_with_splits(b), places=None), f"(SELECT ticker, date, close * l AS close, round(volume / l) AS volume FROM (SELECT *, coalesce(product(splitFactor) OVER {_LATER}, 1) AS l FROM {_SPLITS}))")
_query(
    "split_append", lambda spark, d: _rounded(indicators.split_append(_with_splits(views.bars(spark, d)).where("date < '2000-01-01'"), _with_splits(views.bars(spark, d)).where("date >= '2000-01-01'"), places=None), "close volume"),
    sql.out("close volume", f"(SELECT b.ticker, date, CASE WHEN date < DATE '2000-01-01' THEN close / coalesce(f, 1) ELSE close END AS close, CASE WHEN date < DATE '2000-01-01' THEN round(volume * coalesce(f, 1)) ELSE volume END AS volume FROM bars AS b LEFT JOIN (SELECT ticker, product(splitFactor) AS f FROM {_SPLITS} WHERE date >= DATE '2000-01-01' GROUP BY ticker) AS s ON b.ticker = s.ticker)", keys="ticker, date"),
)
_ACTIVITY = f"""WITH {sql.BARS}, r AS (SELECT *, coalesce({sql.roll('avg', 'dollars', 20)} <= 25000, false) AS fails FROM (SELECT *, close * volume AS dollars FROM bars)),
  g AS (SELECT *, sum(CASE WHEN fails = p THEN 0 ELSE 1 END) OVER {sql._RUN} AS run FROM (SELECT *, lag(fails) OVER ({sql.ORDER}) AS p FROM r)),
  runs AS (SELECT ticker, run, any_value(fails) AS fails, count(*) AS n, min(date) AS a, max(date) AS b FROM g GROUP BY ticker, run),
  t AS (SELECT ticker, sum(n) AS n, bool_or(fails) AS bad, max(b) AS last, min(a) FILTER (NOT fails AND n > 120) AS fa, max(b) FILTER (NOT fails AND n > 120) AS lb FROM runs GROUP BY ticker)
  SELECT ticker, CASE WHEN n < 120 THEN 'notEnoughData' WHEN NOT bad THEN 'active' WHEN fa IS NULL THEN 'deadTicker' WHEN lb = last THEN 'active' ELSE 'recentDatesInactive' END AS designation, n >= 120 AND NOT bad AS passes,
  CASE WHEN n >= 120 AND bad AND lb = last THEN fa END AS keep_from, CASE WHEN n >= 120 AND bad AND lb <> last THEN lb END AS keep_to FROM t"""
_query("activity_check", lambda spark, d: indicators.activity_check(views.bars(spark, d)), _ACTIVITY)

# --- recursive indicators
_on_bars("ema_20", "ema5 ema20 ema250", lambda b: recursive.add(b, "ema"), f"(SELECT *, {', '.join(f'{sql.ewm("close", 2 / (n + 1), 120)} AS ema{n}' for n in (5, 20, 250))} FROM bars)")
_TR = f"(SELECT *, greatest(high - low, abs(high - {sql.lag('close')}), abs(low - {sql.lag('close')})) AS tr FROM bars)"
_ATR = sql.wilder(_TR, "tr", 1 / 20, 120, "atr20")
_on_bars("atr_20", "atr20", lambda b: recursive.add(b, "atr"), _ATR)
_MACD = f"(SELECT *, {sql.ewm('macd', 2 / 10)} AS macdSig FROM (SELECT *, {sql.ewm('close', 2 / 13, 100)} - {sql.ewm('close', 2 / 27, 100)} AS macd FROM bars))"
_on_bars("macd", "macd macdSig macdHist", lambda b: recursive.add(b, "macd"), f"(SELECT *, macd - macdSig AS macdHist FROM {_MACD})")
_RSI = f"""(SELECT *, CASE WHEN i > 14 THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END AS rsi14 FROM (
  SELECT *, sum(up * wt) OVER {sql._RUN} / q AS g, sum(down * wt) OVER {sql._RUN} / q AS l FROM (
    SELECT *, pow({14 / 13!r}, i) AS q, CASE WHEN i BETWEEN 1 AND 14 THEN pow({14 / 13!r}, 14) / 14 WHEN i > 14 THEN pow({14 / 13!r}, i) / 14 ELSE 0 END AS wt,
           greatest(coalesce(close - {sql.lag('close')}, 0), 0) AS up, greatest(coalesce({sql.lag('close')} - close, 0), 0) AS down FROM bars)))"""
_on_bars("rsi_14", "rsi14", lambda b: recursive.add(b, "rsi"), _RSI)
_DM = f"""(SELECT *, CASE WHEN u > d AND u > 0 THEN u ELSE 0 END AS pdm, CASE WHEN d > u AND d > 0 THEN d ELSE 0 END AS mdm FROM (SELECT *, high - {sql.lag('high')} AS u, {sql.lag('low')} - low AS d FROM {_TR}))"""
_DI = sql.wilder(sql.wilder(sql.wilder(_DM, "pdm", 1 / 14, 100, "sp"), "mdm", 1 / 14, 100, "sm"), "tr", 1 / 14, 100, "st")
_DX = f"(SELECT *, 100 * abs(dmiPlus - dmiMinus) / nullif(dmiPlus + dmiMinus, 0) AS dx FROM (SELECT *, 100 * sp / nullif(st, 0) AS dmiPlus, 100 * sm / nullif(st, 0) AS dmiMinus FROM {_DI}))"
_on_bars("adx_14", "adx dmiPlus dmiMinus", lambda b: recursive.add(b, "adx"), sql.wilder(_DX, "dx", 1 / 14, 1, "adx"))
_on_bars(
    "kalman_single", "kalmanClose kalmanTrend", lambda b: recursive.add(b, "kalman"),
    "(SELECT ticker, date, x AS kalmanClose, run AS kalmanTrend FROM r)",
)
_KALMAN = """r AS (SELECT ticker, date, i, close AS x, 100.01 * (1 - 100.01 / 115.01) AS p, 0 AS run FROM bars WHERE i = 0
  UNION ALL SELECT ticker, date, i, nx, np, CASE WHEN nx > x OR (nx = x AND run > 0) THEN greatest(run, 0) + 1 ELSE least(run, 0) - 1 END FROM (
    SELECT b.ticker, b.date, b.i, r.x, r.run, r.x + (r.p + 0.01) / (r.p + 15.01) * (b.close - r.x) AS nx, (r.p + 0.01) * (1 - (r.p + 0.01) / (r.p + 15.01)) AS np FROM r JOIN bars AS b ON b.ticker = r.ticker AND b.i = r.i + 1))"""
ORACLES["kalman_single"] = sql.out("kalmanClose kalmanTrend", "(SELECT ticker, date, x AS kalmanClose, run AS kalmanTrend FROM r)", f"{sql.BARS}, {_KALMAN}")
_on_bars("kalman_states", "kalmanStates", lambda b: recursive.add(b, "kalman_states"))
ORACLES["kalman_states"] = sql.out("kalmanStates", "(SELECT ticker, date, x AS kalmanStates FROM r)", f"{sql.BARS}, {_KALMAN}")
_KAMA = f"""s AS MATERIALIZED (SELECT *, CASE WHEN a IS NULL THEN 0 ELSE pow(coalesce(er, 0) * (2 / (fast + 1) - 2 / (slow + 1)) + 2 / (slow + 1), 2) END AS sc FROM (
    SELECT *, trunc(greatest(2, 5 - 3 * a)) AS fast, trunc(greatest(20, 30 + 10 * a)) AS slow FROM (
      SELECT *, CASE WHEN path > 0 THEN abs(close - {sql.lag('close', 20)}) / path END AS er, atr20 / {sql.roll('avg', 'atr20', 120)} AS a, CASE WHEN i = 19 THEN avg(close) OVER {sql.frame(20)} END AS seed FROM (
        SELECT *, {sql.roll('sum', 'step', 20)} AS path FROM (SELECT *, abs(close - {sql.lag('close')}) AS step FROM {_ATR}))))),
  r AS (SELECT ticker, date, i, seed AS k FROM s WHERE i = 19 UNION ALL SELECT s.ticker, s.date, s.i, r.k + s.sc * (s.close - r.k) FROM r JOIN s ON s.ticker = r.ticker AND s.i = r.i + 1)"""
_on_bars("kama_20", "kama20", lambda b: recursive.add(b, "atr", "kama"))
ORACLES["kama_20"] = sql.out("kama20", "(SELECT s.ticker, s.date, nullif(k, 0) AS kama20 FROM s LEFT JOIN r USING (ticker, i))", f"{sql.BARS}, {_KAMA}")
_PSAR = """b2 AS MATERIALIZED (SELECT *, lag(high) OVER w AS h1, lag(high, 2) OVER w AS h2, lag(low) OVER w AS l1, lag(low, 2) OVER w AS l2 FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
  r AS (SELECT ticker, date, i, high > h1 AS up, CASE WHEN high > h1 THEN least(low, l1) ELSE greatest(high, h1) END AS sar, CASE WHEN high > h1 THEN greatest(high, h1) ELSE least(low, l1) END AS ep, 0.02::DOUBLE AS af, high AS hi, low AS lo FROM b2 WHERE i = 1
    UNION ALL SELECT ticker, date, i, CASE WHEN flip THEN NOT up ELSE up END, CASE WHEN flip THEN CASE WHEN up THEN hi ELSE lo END ELSE cand END,
      CASE WHEN flip THEN CASE WHEN up THEN low ELSE high END WHEN up THEN greatest(ep, high) ELSE least(ep, low) END,
      CASE WHEN flip THEN 0.02 WHEN up AND high > ep OR NOT up AND low < ep THEN least(0.2, af + 0.02) ELSE af END, CASE WHEN flip THEN high ELSE greatest(hi, high) END, CASE WHEN flip THEN low ELSE least(lo, low) END
    FROM (SELECT *, CASE WHEN up THEN cand > low ELSE cand < high END AS flip FROM (SELECT b.ticker, b.date, b.i, b.high, b.low, r.up, r.ep, r.af, r.hi, r.lo,
      CASE WHEN r.up THEN least(r.sar + r.af * (r.ep - r.sar), b.l1, b.l2) ELSE greatest(r.sar + r.af * (r.ep - r.sar), b.h1, b.h2) END AS cand FROM r JOIN b2 AS b ON b.ticker = r.ticker AND b.i = r.i + 1)))"""
_on_bars("psar", "psar", lambda b: recursive.add(b, "psar"))
ORACLES["psar"] = sql.out("psar", "(SELECT b2.ticker, b2.date, sar AS psar FROM b2 LEFT JOIN r USING (ticker, i))", f"{sql.BARS}, {_PSAR}")


def _scored(b: DataFrame) -> DataFrame:
    return recursive.add(indicators.on_balance_volume(b), "atr", "macd", "adx", "kama", "trend_score", "swing_confirmation")


_on_bars("wavelet_db6", "wavelet_db6", lambda b: recursive.add(b, "wavelet"))
_on_bars("trend_score", "trendScore", _scored)
_query("swing_confirmation", lambda spark, d: _rounded(_scored(views.bars(spark, d)), "retracementThreshold retracementTrend retraceConfidence", "ticker date retracementThresholdCrossover reversalConf"))

# --- candlesticks
_query("candles_all", lambda spark, d: candles.candles(views.bars(spark, d)).select("ticker", "date", *candles.PATTERNS), f"WITH {sql.BARS} {candles.candles_sql('bars')}")
_query(
    "candle_cutoffs", lambda spark, d: _rounded(candles.cutoffs(views.bars(spark, d)).select("ticker", *candles.CUTOFFS).distinct(), " ".join(candles.CUTOFFS), "ticker"),
    sql.out(list(candles.CUTOFFS), "(SELECT ticker, " + ", ".join(f"quantile_cont({x}, {p / 100}) AS {n}" for n, (x, p) in candles.CUTOFFS.items()) + " FROM (SELECT *, CASE WHEN close >= open THEN close - open END AS up_body, CASE WHEN close < open THEN open - close END AS down_body, abs(close - open) AS body_size, high - greatest(open, close) AS upper_tail, least(open, close) - low AS lower_tail FROM bars) GROUP BY ticker)", keys="ticker"),
)


# --- signals
def technicals(b: DataFrame) -> DataFrame:
    """Bars with every column that a configured signal reads."""
    for f in (indicators.demand_pressure, indicators.williams_r, indicators.cci, indicators.bollinger, indicators.kst, indicators.stochastic, indicators.extremes_distance, indicators.on_balance_volume):
        b = f(b)
    return recursive.add(b, "atr", "macd", "demand_index", "rsi", "adx", "psar", "kama", "trend_score", "swing_confirmation").drop("demandRaw")



def _simple(b: DataFrame) -> DataFrame:
    return indicators.kst(indicators.stochastic(indicators.williams_r(b)))


_SIMPLE = _KST.replace("FROM bars", "FROM " + _STOCHASTIC.replace("FROM bars", "FROM " + _WILLIAMS))


def _signal(name: str, feature: str, clauses: dict, condition: str | None, relation: str = _SIMPLE) -> None:
    _query(name, lambda spark, d: signals.compile_signals(_simple(views.bars(spark, d)), {"signal": (feature, clauses)}).select("ticker", "date", "signal"), None if condition is None else f"WITH {sql.BARS} SELECT ticker, date, coalesce({condition}, false) AS signal FROM {relation}")


def _cross(a: str, b: str) -> str:
    return f"({a} >= {b} AND {sql.lag(a)} <= {sql.lag(b) if not b.lstrip('-').isdigit() else b})"


_signal("sig_threshold_const", "williamsR14", {"threshold": {"below": -80}}, "williamsR14 <= -80")
_signal("sig_threshold_pct", "stochasticK20", {"threshold": {"above": "90th"}}, f"stochasticK20 >= {sql.percentile('stochasticK20', 90)}")
_signal("sig_length", "williamsR14", {"threshold": {"below": -80, "length": 3}}, f"sum(CAST(coalesce(williamsR14 <= -80, false) AS INTEGER)) OVER {sql.frame(3)} = 3")
_signal("sig_crossover_col", "stochasticK20", {"crossover": {"above": "stochasticD20"}}, _cross("stochasticK20", "stochasticD20"))
_signal("sig_crossover_zero", "kst", {"crossover": {"above": 0}}, _cross("kst", "0"))
_signal("sig_multi_and", "stochasticK20", {"crossover": {"above": "stochasticD20"}, "threshold": {"below": 20}}, f"{_cross('stochasticK20', 'stochasticD20')} AND stochasticK20 <= 20")
_signal("sig_multi_or", "williamsR14", {"threshold": {"below": -90}, "threshold2": {"above": -5}}, "coalesce(williamsR14 <= -90, false) OR coalesce(williamsR14 >= -5, false)")
_GAP = f"(SELECT *, CASE WHEN zf < zc THEN abs(zf - zc) END AS gap FROM (SELECT *, {sql.rolling_z('williamsR14')} AS zf, {sql.rolling_z('close')} AS zc FROM {_SIMPLE}))"
_signal("sig_divergence", "williamsR14", {"divergence": {"coFeature": "close", "above": "75th"}}, f"gap >= {sql.percentile('gap', 75)}", _GAP)
_signal("sig_convergence", "williamsR14", {"convergence": {"coFeature": "close", "below": "25th"}}, f"gap <= {sql.percentile('gap', 25)}", _GAP)
_signal("sig_threshold_trend", "stochasticK20", {"threshold": {"trend": 10, "above": "60th"}}, f"s >= {sql.percentile('s', 60)}", f"(SELECT *, {sql.slope('stochasticK20', 10)} AS s FROM {_SIMPLE})")
_signal("sig_failure_swing", "williamsR14", {"failureSwing": {"bottom": 14, "thresh": -80}}, None)
_query("sig_all_configured", lambda spark, d: series.configured(views.bars(spark, d)).select("ticker", "date", *signals.SIGNALS))


def _turning(b: DataFrame) -> DataFrame:
    """A simple trend, its turns and two signals, to test scores and backtests apart from the swings."""
    b = _simple(b).withColumn("m", w.mean("close", 20)).withColumn("retracementTrend", F.when(F.col("close") >= F.col("m"), 1).otherwise(-1))
    turn = F.when(F.col("retracementTrend") > w.lag("retracementTrend"), "toUp").when(F.col("retracementTrend") < w.lag("retracementTrend"), "toDown").otherwise("None")
    return b.withColumn("reversalConf", turn).withColumn("bullish_low", w.truth(F.col("williamsR14") <= -95)).withColumn("bearish_high", w.truth(F.col("williamsR14") >= -5))


_TURNING = f"(SELECT *, CASE WHEN t > {sql.lag('t')} THEN 'toUp' WHEN t < {sql.lag('t')} THEN 'toDown' ELSE 'None' END AS conf, coalesce(williamsR14 <= -95, false) AS lo, coalesce(williamsR14 >= -5, false) AS hi FROM (SELECT *, CASE WHEN close >= {sql.roll('avg', 'close', 20)} THEN 1 ELSE -1 END AS t FROM {_WILLIAMS}))"
_SCORES = "CASE WHEN lo THEN CASE WHEN t = -1 THEN 0.5 ELSE 0.25 END ELSE 0.0 END AS bullish_low_sig, CASE WHEN hi THEN CASE WHEN t = 1 THEN -0.5 ELSE -0.25 END ELSE 0.0 END AS bearish_high_sig"
_query(
    "sig_rev_cont", lambda spark, d: _turning(views.bars(spark, d)).select("ticker", "date", signals.turn("bullish_low").alias("bullish"), signals.turn("bearish_high").alias("bearish")),
    f"WITH {sql.BARS} SELECT ticker, date, CASE WHEN t = -1 THEN 'rev' ELSE 'cont' END AS bullish, CASE WHEN t = 1 THEN 'rev' ELSE 'cont' END AS bearish FROM {_TURNING}",
)


def _scores(b: DataFrame) -> DataFrame:
    return signals.score(_turning(b), ["bullish_low", "bearish_high"])


_on_bars("sig_score_defaults", "bullish_low_sig bearish_high_sig", _scores, f"(SELECT *, {_SCORES} FROM {_TURNING})")
_on_bars("total_score", "totalScore", lambda b: signals.total_score(_scores(b)), f"(SELECT *, {sql.roll('avg', 'both_', 3)} AS totalScore FROM (SELECT *, bullish_low_sig + bearish_high_sig AS both_ FROM (SELECT *, {_SCORES} FROM {_TURNING})))")


def _tested(spark: SparkSession, d: str) -> DataFrame:
    return signals.backtest(_scores(views.bars(spark, d).join(views.listing(spark, d), "ticker")))


_AHEAD = f"({sql.ORDER} ROWS BETWEEN CURRENT ROW AND 60 FOLLOWING)"
_BACKTEST = f"""{sql.BARS}, {sql.LISTING}, f AS (SELECT *, bool_or(conf = 'toUp') OVER {_AHEAD} AS u, bool_or(conf = 'toDown') OVER {_AHEAD} AS dn, max(date) OVER (PARTITION BY ticker) AS last FROM {_TURNING}),
  s AS (SELECT ticker, last, 'bullish_low_sig' AS signalName, lo AND t = -1 AS rev, lo AND t = 1 AS cont, u AS turned, NOT u AND NOT dn AS quiet FROM f UNION ALL SELECT ticker, last, 'bearish_high_sig', hi AND t = 1, hi AND t = -1, dn, NOT u AND NOT dn FROM f),
  tested AS (SELECT last AS date, ticker, sector, cap, exchange, split_part(signalName, '_', 2) AS indicator, signalName, count(*) FILTER (rev) AS reversalCount, count(*) FILTER (rev AND turned) AS reversalSuccess, count(*) FILTER (rev AND NOT turned) AS reversalFailure,
    count(*) FILTER (cont) AS continuationCount, count(*) FILTER (cont AND quiet) AS continuationSuccess, count(*) FILTER (cont AND NOT quiet) AS continuationFailure FROM s JOIN listing USING (ticker) GROUP BY ALL)"""
_query("backtest_forward_61", _tested, f"WITH {_BACKTEST} SELECT * FROM tested")
_RATE = "coalesce(avg({k}Success::DOUBLE / nullif({k}Count, 0)), 0) * CASE WHEN signalName LIKE 'bearish%' THEN -1 ELSE 1 END AS {k}"
_query("success_rates", lambda spark, d: _rounded(signals.success_rates(_tested(spark, d)), "reversal continuation", "sector signalName"), sql.out("reversal continuation", f"(SELECT sector, signalName, {_RATE.format(k='reversal')}, {_RATE.format(k='continuation')} FROM tested GROUP BY sector, signalName)", _BACKTEST, "sector, signalName"))


def _rated(spark: SparkSession, d: str) -> DataFrame:
    rates = signals.success_rates(_tested(spark, d))
    return signals.score(_turning(views.bars(spark, d).join(views.listing(spark, d), "ticker")), ["bullish_low", "bearish_high"], rates)


_query(
    "sig_score_rates", lambda spark, d: _rounded(_rated(spark, d), "bullish_low_sig bearish_high_sig"),
    sql.out("bullish_low_sig bearish_high_sig", "(SELECT t_.ticker, date, CASE WHEN lo THEN CASE WHEN t = -1 THEN b.reversal ELSE b.continuation END ELSE 0.0 END AS bullish_low_sig, CASE WHEN hi THEN CASE WHEN t = 1 THEN s.reversal ELSE s.continuation END ELSE 0.0 END AS bearish_high_sig FROM " + _TURNING + " AS t_ JOIN listing AS l ON l.ticker = t_.ticker JOIN rates AS b ON b.sector = l.sector AND b.signalName = 'bullish_low_sig' JOIN rates AS s ON s.sector = l.sector AND s.signalName = 'bearish_high_sig')", f"{_BACKTEST}, rates AS (SELECT sector, signalName, {_RATE.format(k='reversal')}, {_RATE.format(k='continuation')} FROM tested GROUP BY sector, signalName)"),
)

# --- fundamentals
_CODES = {"incomeStatement": ["netinc", "revenue", "grossProfit", "opinc"], "balanceSheet": ["equity", "totalAssets", "assetsCurrent", "liabilitiesCurrent", "debt"], "cashFlow": ["capex"]}
_WIDE = """wide AS (SELECT o_custkey AS ticker, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date, sum(o_totalprice) AS revenue, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS netinc, sum(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice ELSE 0 END) AS grossProfit,
  sum(CASE WHEN p <= '3' THEN o_totalprice ELSE 0 END) AS opinc, sum(CASE WHEN p = '1' THEN o_totalprice ELSE 0 END) AS equity, sum(o_totalprice * 2) AS totalAssets, sum(CASE WHEN p <= '2' THEN o_totalprice ELSE 0 END) AS assetsCurrent,
  sum(CASE WHEN p >= '4' THEN o_totalprice ELSE 0 END) AS liabilitiesCurrent, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS debt, sum(CASE WHEN p = '5' THEN o_totalprice ELSE 0 END) AS capex FROM (SELECT *, substr(o_orderpriority, 1, 1) AS p FROM orders) GROUP BY ALL)"""


def _statements(name: str, kinds: list[str]) -> None:
    columns = " ".join(c for t in kinds for c in _CODES[t])
    _query(name, lambda spark, d: _rounded(fundamentals.joined(views.statements(spark, d), kinds, _CODES), columns, digits=2), sql.out(columns, "wide", _WIDE, digits=2))


_statements("stmt_join_2", ["incomeStatement", "balanceSheet"])
_statements("stmt_join_3", ["incomeStatement", "balanceSheet", "cashFlow"])
_query("stmt_pivot", lambda spark, d: _rounded(fundamentals.pivot(views.statements(spark, d), "incomeStatement", _CODES["incomeStatement"]), " ".join(_CODES["incomeStatement"]), digits=2), sql.out(_CODES["incomeStatement"], "wide", _WIDE, digits=2))


def _nested(spark: SparkSession, d: str) -> DataFrame:
    rows = views.statements(spark, d).groupBy("ticker", "date").pivot("stmt_type", list(_CODES)).agg(F.collect_list(F.struct("dataCode", "value")))
    return fundamentals.unnest(rows.select("ticker", "date", (F.quarter("date") % 4).alias("quarter"), F.struct(*_CODES).alias("statementData")))


_query(
    "stmt_unnest", lambda spark, d: _nested(spark, d).groupBy("stmt_type", "dataCode").agg(F.count("*").alias("rows")),
    f"WITH {_WIDE} SELECT t AS stmt_type, c AS dataCode, count(*) AS rows FROM wide CROSS JOIN (VALUES " + ", ".join(f"('{t}', '{c}')" for t, cs in _CODES.items() for c in cs) + ") AS v(t, c) WHERE quarter(date) <> 4 GROUP BY t, c",
)


def _ratio_sql(name: str) -> str:
    a, b = fundamentals.RATIOS[name]
    have = {c for cs in _CODES.values() for c in cs}
    return f"coalesce({a} / nullif({b}, 0), 0) AS {name}" if {*a.split(" + "), b} <= have else f"0.0 AS {name}"


_query("ratios_12", lambda spark, d: _rounded(fundamentals.ratios(fundamentals.joined(views.statements(spark, d), list(_CODES), _CODES)), " ".join(fundamentals.RATIOS)), sql.out(list(fundamentals.RATIOS), f"(SELECT ticker, date, {', '.join(map(_ratio_sql, fundamentals.RATIOS))} FROM wide)", _WIDE))

# --- features
_P = "(PARTITION BY ticker)"
_SCALES = {
    "robust": f"(x - quantile_cont(x, 0.5) OVER {_P}) / coalesce(nullif(quantile_cont(x, 0.75) OVER {_P} - quantile_cont(x, 0.25) OVER {_P}, 0), 1)",
    "minmax": f"(x - min(x) OVER {_P}) / coalesce(nullif(max(x) OVER {_P} - min(x) OVER {_P}, 0), 1)",
    "maxabs": f"x / coalesce(nullif(max(abs(x)) OVER {_P}, 0), 1)",
    "standard": f"(x - avg(x) OVER {_P}) / coalesce(nullif(stddev_pop(x) OVER {_P}, 0), 1)",
    "quantile": f"CASE WHEN x IS NULL THEN NULL WHEN count(x) OVER {_P} = 1 THEN 0 ELSE (rank() OVER (PARTITION BY ticker ORDER BY x NULLS LAST) - 1 + (count(x) OVER (PARTITION BY ticker, x) - 1) / 2) / (count(x) OVER {_P} - 1) END",
}
for _kind, _e in _SCALES.items():
    _on_bars(f"scale_{_kind}", "close", lambda b, k=_kind: features.scale(b, ["close"], k), f"(SELECT ticker, date, {_e} AS close FROM (SELECT *, close AS x FROM bars))")
_ERA = " + ".join(f"CAST(date >= DATE '{s}' AS INTEGER)" for s in w.ERA_STARTS)
_on_bars("scale_by_era", "close", lambda b: features.scale(b, ["close"], "MinMax", by_era=True), f"(SELECT ticker, date, {_SCALES['minmax'].replace(_P, '(PARTITION BY ticker, e)')} AS close FROM (SELECT *, close AS x, {_ERA} AS e FROM bars))")
_on_bars("scale_power", "close", lambda b: features.scale(b, ["close"], "PowerTransformer"))
_STATS = {"mean": "avg", "std": "stddev_pop", "min": "min", "max": "max"}
_on_bars("roll_stats", " ".join(f"close_{s}_{n}" for n in (5, 10, 20) for s in _STATS), lambda b: features.roll(b, ["close"], [5, 10, 20]), f"(SELECT *, {', '.join(f'{sql.roll(f, "close", n)} AS close_{s}_{n}' for n in (5, 10, 20) for s, f in _STATS.items())} FROM bars)")
_on_bars("lags", " ".join(f"close_lagged_{n}" for n in (1, 2, 3, 5)), lambda b: features.lags(b, ["close"]), f"(SELECT *, {', '.join(f'{sql.lag("close", n)} AS close_lagged_{n}' for n in (1, 2, 3, 5))} FROM bars)")


# --- universe and table changes
def _raw_listing(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "customer")
    names = F.array(*map(F.lit, universe.EXCHANGES + ["LSE"]))
    start = F.date_add(F.lit("1990-01-01").cast("date"), F.col("c_custkey").cast("int") % 3000)
    return c.select(
        F.concat(F.lit("P"), "c_custkey").alias("permaTicker"), F.concat(F.lit("T"), F.col("c_custkey") % 700).alias("ticker"), F.get(names, (F.col("c_custkey") % 16).cast("int")).alias("exchange"),
        F.when(F.col("c_nationkey") % 3 == 0, "ETF").when(F.col("c_nationkey") % 3 == 1, "Stock").otherwise("Mutual Fund").alias("assetType"), (F.col("c_acctbal") > 0).alias("isActive"),
        F.when(F.col("c_custkey") % 11 != 0, start).alias("startDate"), F.date_add(start, (F.col("c_custkey") % 5 * 400).cast("int")).alias("endDate"),
    )


_EXCHANGES = ", ".join(f"'{x}'" for x in [*universe.EXCHANGES, "LSE"])
_RAW = f"""raw AS (SELECT 'P' || c_custkey AS permaTicker, 'T' || (c_custkey % 700) AS ticker, [{_EXCHANGES}][c_custkey % 16 + 1] AS exchange, CASE c_nationkey % 3 WHEN 0 THEN 'ETF' WHEN 1 THEN 'Stock' ELSE 'Mutual Fund' END AS assetType, c_acctbal > 0 AS isActive,
  CASE WHEN c_custkey % 11 <> 0 THEN s END AS startDate, CAST(s + CAST(c_custkey % 5 * 400 AS INTEGER) AS DATE) AS endDate FROM (SELECT *, CAST(DATE '1990-01-01' + CAST(c_custkey % 3000 AS INTEGER) AS DATE) AS s FROM customer)),
  meta AS (SELECT permaTicker, ticker, lower(CASE {' '.join(f"WHEN exchange = '{a}' THEN '{b}'" for a, b in universe.CONSOLIDATED.items())} ELSE exchange END) AS exchange, lower(assetType) AS assetType, isActive, startDate, endDate,
    row_number() OVER (PARTITION BY ticker ORDER BY startDate DESC, permaTicker) > 1 AS duplicated, CAST(year(endDate) - year(startDate) AS BIGINT) AS yearsListed, CASE WHEN isActive THEN 'active' ELSE 'delisted' END AS designation
    FROM raw WHERE exchange <> 'LSE' AND assetType IN ('Stock', 'ETF') AND startDate IS NOT NULL AND startDate IS DISTINCT FROM endDate)"""


def _meta(spark: SparkSession, d: str) -> DataFrame:
    return universe.clean_listing(_raw_listing(spark, d))


_query("listing_clean", _meta, f"WITH {_RAW} SELECT * FROM meta")
_query("exchange_map", lambda spark, d: _raw_listing(spark, d).select("permaTicker", universe.exchange_name(F.col("exchange")).alias("exchange")), f"WITH {_RAW} SELECT permaTicker, lower(CASE {' '.join(f"WHEN exchange = '{a}' THEN '{b}'" for a, b in universe.CONSOLIDATED.items())} ELSE exchange END) AS exchange FROM raw")
_query("dup_flag", lambda spark, d: _meta(spark, d).select("permaTicker", "ticker", "duplicated"), f"WITH {_RAW} SELECT permaTicker, ticker, duplicated FROM meta")
_query("canonical_ticker", lambda spark, d: _meta(spark, d).select("permaTicker", universe.canonical_ticker().alias("name")), f"WITH {_RAW} SELECT permaTicker, CASE WHEN duplicated THEN permaTicker ELSE ticker END AS name FROM meta")


def _ready(spark: SparkSession, d: str) -> DataFrame:
    ready = F.length("permaTicker") % 2 == 0
    return _meta(spark, d).withColumn("pricesInitialized", ready).withColumn("fundamentalsInitialized", ready)


_query("universe_prices", lambda spark, d: universe.price_universe(_ready(spark, d)).select("permaTicker"), f"WITH {_RAW} SELECT permaTicker FROM meta WHERE designation = 'active' OR (designation <> 'deadTicker' AND length(permaTicker) % 2 = 1)")
_query("universe_fundamentals", lambda spark, d: universe.fundamentals_universe(_ready(spark, d)).select("permaTicker"), f"WITH {_RAW} SELECT permaTicker FROM meta WHERE assetType = 'stock' AND (designation = 'active' OR (designation <> 'deadTicker' AND length(permaTicker) % 2 = 1))")
_query("cap_category", lambda spark, d: views.listing(spark, d).groupBy("cap").agg(F.count("*").alias("n")), f"WITH {sql.LISTING} SELECT cap, count(*) AS n FROM listing GROUP BY cap")


def _profile(spark: SparkSession, d: str) -> DataFrame:
    return universe.with_profile(_meta(spark, d), _raw_listing(spark, d).where("isActive").select("permaTicker", "ticker", F.concat(F.lit("S"), F.length("permaTicker").cast("string")).alias("sector"))).select("permaTicker", "sector")


_query("listing_profile", _profile, f"WITH {_RAW} SELECT m.permaTicker, coalesce('S' || length(r.permaTicker), 'Unknown') AS sector FROM meta AS m LEFT JOIN (SELECT * FROM raw WHERE isActive) AS r ON r.permaTicker = m.permaTicker AND r.ticker = m.ticker")
_OLD, _NEW = "date < '1999-01-01'", "date >= '1998-01-01'"
_OLD_SQL, _NEW_SQL = "date < DATE '1999-01-01'", "date >= DATE '1998-01-01'"


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = views.bars(spark, d).select("ticker", "date", "volume")
    return b.where(_OLD), b.where(_NEW).withColumn("volume", F.col("volume") + 1)


_KEYS = ["ticker", "date"]
_query("insert_if_absent", lambda spark, d: universe.insert_if_absent(*_versions(spark, d), _KEYS), f"WITH {sql.BARS} SELECT ticker, date, CASE WHEN {_OLD_SQL} THEN volume ELSE volume + 1 END AS volume FROM bars")
_query("upsert_latest", lambda spark, d: universe.upsert(*_versions(spark, d), _KEYS), f"WITH {sql.BARS} SELECT ticker, date, CASE WHEN {_NEW_SQL} THEN volume + 1 ELSE volume END AS volume FROM bars")
_query("update_from", lambda spark, d: universe.update_from(*_versions(spark, d), _KEYS, ["volume"], F.col("ticker") % 2 == 0), f"WITH {sql.BARS} SELECT ticker, date, CASE WHEN {_NEW_SQL} AND ticker % 2 = 0 THEN volume + 1 ELSE volume END AS volume FROM bars WHERE {_OLD_SQL}")
_query("delete_not_in", lambda spark, d: universe.delete_not_in(*_versions(spark, d), _KEYS), f"WITH {sql.BARS} SELECT ticker, date, volume FROM bars WHERE {_OLD_SQL} AND {_NEW_SQL}")
_query("add_missing_columns", lambda spark, d: _rounded(views.bars(spark, d).where(_OLD).select("ticker", "date", "volume").unionByName(views.bars(spark, d).where(_NEW).select("ticker", "date", "volume", "close"), allowMissingColumns=True), "volume close"), sql.out("volume close", f"(SELECT ticker, date, volume, NULL::DOUBLE AS close FROM bars WHERE {_OLD_SQL} UNION ALL SELECT ticker, date, volume, close FROM bars WHERE {_NEW_SQL})"))
_query("primary_key_check", lambda spark, d: universe.unique(views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"]), "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
_query("calendar_days", lambda spark, d: calendar.days(spark, "1997-01-01", "1999-12-31").select("date", calendar.is_weekday(F.col("date")).alias("weekday"), calendar.nth_friday(F.col("date"), 3).alias("third_friday")), "SELECT CAST(d AS DATE) AS date, dayofweek(d) BETWEEN 1 AND 5 AS weekday, dayofweek(d) = 5 AND ceil(day(d) / 7.0) = 3 AS third_friday FROM range(DATE '1997-01-01', DATE '2000-01-01', INTERVAL 1 DAY) AS t(d)")


# --- traffic
def _vehicles(spark: SparkSession, d: str) -> DataFrame:
    return traffic.features(views.traffic(spark, d))


#: Speed bands stand in for clusters where SQL has to follow.
_BANDED = "(SELECT *, CASE WHEN velocity < 40 THEN 0 WHEN velocity < 70 THEN 1 ELSE 2 END AS cluster_num FROM traffic)"


def _banded(spark: SparkSession, d: str) -> DataFrame:
    return _vehicles(spark, d).withColumn("cluster_num", F.when(F.col("velocity") < 40, 0).when(F.col("velocity") < 70, 1).otherwise(2))


def _on_traffic(name: str, columns: str, keys: str, build: Callable[[SparkSession, str], DataFrame], relation: str | None, digits: int = 4) -> None:
    _query(name, lambda spark, d: _rounded(build(spark, d), columns, keys, digits), None if relation is None else sql.out(columns, relation, sql.TRAFFIC, ", ".join(keys.split()) or "0 AS x", digits))


_SPREAD = ", ".join(f"{f}({c}) AS {n}_{c}" for c in ("velocity", "travel_time") for n, f in (("mean", "avg"), ("stddev", "stddev_samp"), ("min", "min"), ("max", "max")))
_SPREADS = " ".join(f"{n}_{c}" for c in ("velocity", "travel_time") for n in ("mean", "stddev", "min", "max"))
_on_traffic("tod_summary", "count " + _SPREADS, "interval_index vehicle_type", lambda s, d: traffic.time_of_day(_vehicles(s, d), "vehicle_type"), f"(SELECT interval_index, vehicle_type, count(*) AS count, {_SPREAD} FROM traffic GROUP BY ALL)")
_on_traffic("volume_distribution", "count mean_volume stddev_volume", "interval_index", lambda s, d: traffic.volume_distribution(_vehicles(s, d)), "(SELECT interval_index, count(*) AS count, avg(volume) AS mean_volume, stddev_samp(volume) AS stddev_volume FROM traffic GROUP BY interval_index)")
_on_traffic("cluster_summary_by_band", "count speeders_count " + _SPREADS, "cluster_num", lambda s, d: traffic.cluster_summary(_banded(s, d)), f"(SELECT cluster_num, count(*) AS count, count(*) FILTER (velocity >= 70) AS speeders_count, {_SPREAD} FROM {_BANDED} GROUP BY cluster_num)")
_on_traffic("tod_frequencies", "frequency", "cluster_num interval_index", lambda s, d: traffic.frequencies(_banded(s, d)), f"(SELECT cluster_num, interval_index, count(*) AS frequency FROM {_BANDED} GROUP BY ALL)")
_on_traffic("share_of_interval", "count mean_cluster_time stddev_cluster_time share", "interval_index cluster_num", lambda s, d: traffic.shares(_banded(s, d)), f"(SELECT *, count / sum(count) OVER (PARTITION BY interval_index) AS share FROM (SELECT interval_index, cluster_num, count(*) AS count, avg(travel_time) AS mean_cluster_time, stddev_samp(travel_time) AS stddev_cluster_time FROM {_BANDED} GROUP BY ALL))")
_on_traffic("cyclic_encoding", "interval_index interval_cos interval_sin root4_velocity root4_travel_time volume", "id weekday", _vehicles, "(SELECT *, dayofweek(datetime) BETWEEN 1 AND 5 AS weekday, cos(radians(interval_index * 360 / 96)) AS interval_cos, sin(radians(interval_index * 360 / 96)) AS interval_sin, pow(velocity, 0.25) AS root4_velocity, pow(travel_time, 0.25) AS root4_travel_time FROM traffic)")
_query("label_encode", lambda spark, d: traffic.label_encoding(_vehicles(spark, d)).select("id", F.col("vehicle_encoding").cast("long")), f"WITH {sql.TRAFFIC} SELECT id, dense_rank() OVER (PARTITION BY datetime ORDER BY vehicle_type) - 1 AS vehicle_encoding FROM traffic")
_query("daily_id", lambda spark, d: traffic.daily_id(_vehicles(spark, d)).select("id", F.col("day_id").cast("long")), f"WITH {sql.TRAFFIC} SELECT id, row_number() OVER (PARTITION BY CAST(datetime AS DATE) ORDER BY datetime, id) AS day_id FROM traffic")
_on_traffic("accident_details", "velocity", "id datetime", lambda s, d: traffic.accident_details(_vehicles(s, d)), "(SELECT * FROM traffic WHERE accident = 1)")
_on_traffic("accident_rate", "accident_intervals vehicles accident_rate", "one", lambda s, d: traffic.accident_rate(_vehicles(s, d)).withColumn("one", F.lit(1)), "(SELECT 1 AS one, count(DISTINCT CASE WHEN accident = 1 THEN datetime END) AS accident_intervals, count(*) AS vehicles, count(DISTINCT CASE WHEN accident = 1 THEN datetime END) / nullif(count(*) * 5 / 1e6, 0) AS accident_rate FROM traffic)")
_on_traffic("speeding_by_slot", "vehicles speeders percent_speeding", "interval_index", lambda s, d: traffic.speeding_by_slot(_vehicles(s, d)), "(SELECT interval_index, count(*) AS vehicles, count(*) FILTER (velocity >= 70) AS speeders, count(*) FILTER (velocity >= 70) * 100 / count(*) AS percent_speeding FROM traffic GROUP BY interval_index)")
_on_traffic("weighted_speed", "mean_speed mean_minutes", "one", lambda s, d: traffic.weighted_speed(_vehicles(s, d)).withColumn("one", F.lit(1)), "(SELECT 1 AS one, v AS mean_speed, 60 / nullif(v, 0) * 5 AS mean_minutes FROM (SELECT avg(velocity) AS v FROM traffic))")
_on_traffic("pct_rank_threshold", "threshold", "one", lambda s, d: traffic.lower_share_threshold(_vehicles(s, d)).withColumn("one", F.lit(1)), "(SELECT 1 AS one, min(travel_time) AS threshold FROM (SELECT travel_time, percent_rank() OVER (ORDER BY travel_time) AS p FROM traffic WHERE travel_time IS NOT NULL) WHERE p >= 0.2)")
_on_traffic("log_time_stats", "mean_log_time stddev_log_time", "one", lambda s, d: traffic.log_time(_vehicles(s, d)).withColumn("one", F.lit(1)), "(SELECT 1 AS one, avg(x) AS mean_log_time, stddev_samp(x) AS stddev_log_time FROM (SELECT ln(CASE WHEN travel_time > 0 THEN travel_time END) AS x FROM traffic))")
_on_traffic("forecast_kpis", "vehicles accidents accident_rate percent_speeding mean_time", "scenario", lambda s, d: traffic.kpis(_vehicles(s, d).withColumn("scenario", F.col("vehicle_type"))), "(SELECT vehicle_type AS scenario, count(*) AS vehicles, sum(accident) AS accidents, sum(accident) / (count(*) * 5 / 1e6) AS accident_rate, count(*) FILTER (velocity >= 70) * 100 / count(*) AS percent_speeding, avg(travel_time) AS mean_time FROM traffic GROUP BY vehicle_type)")


# --- models: checked by tests of their properties
def _road(spark: SparkSession, d: str) -> DataFrame:
    """Vehicles with positive times: the models' input."""
    return _vehicles(spark, d).where("velocity > 0 AND travel_time > 0")


_query("traffic_generate", lambda spark, d: traffic.simulate(spark, "2024-06-01", 2).groupBy("datetime").agg(F.count("*").alias("volume"), F.avg("velocity").alias("mean_velocity"), F.sum("accident").alias("accidents")))
_query("kmeans_ordered", lambda spark, d: traffic.cluster_summary(models.clusters(_road(spark, d))))


def _scores_of(spark: SparkSession, values: dict[str, dict[str, float]]) -> DataFrame:
    return spark.createDataFrame([(m, {k: float(v) for k, v in s.items()}) for m, s in values.items()], "model string, scores map<string,float>")


_query("silhouette", lambda spark, d: _scores_of(spark, {"kmeans": {"silhouette": models.silhouette(models.clusters(_road(spark, d)))}}))


def _logit(spark: SparkSession, d: str) -> DataFrame:
    train, test = models.split(_road(spark, d))
    return _scores_of(spark, {"logistic": models.accident_metrics(models.fit_accidents(train), test)})


def _threshold(rows: DataFrame) -> float:
    return float(traffic.lower_share_threshold(rows).first()[0])


def _linreg(spark: SparkSession, d: str) -> DataFrame:
    rows = _road(spark, d)
    train, test = models.split(rows)
    return _scores_of(spark, {"linear": models.speed_metrics(models.fit_speed(train, _threshold(rows)), test)})


def _forecast(spark: SparkSession, d: str) -> DataFrame:
    rows = models.clusters(_road(spark, d))
    train, _ = models.split(rows)
    slow = traffic.log_time(rows.where("cluster_num = 0"))
    out = models.forecast(traffic.volume_distribution(rows), traffic.shares(rows), slow, models.fit_speed(train, _threshold(rows)), models.fit_accidents(train))
    return traffic.kpis(out)


_query("logit_metrics", _logit)
_query("linreg_two_band", _linreg)
_query("scenario_forecast", _forecast)


# --- joins and changes of stored tables
def _daily_values(spark: SparkSession, d: str) -> DataFrame:
    """Stands in for daily fundamentals: a value for some days of each ticker."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    return lines.where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("date")).agg(F.max("l_tax").alias("marketCap"), F.sum("l_discount").alias("enterpriseVal"))


_query(
    "prices_daily_join", lambda spark, d: _rounded(fundamentals.with_daily(views.bars(spark, d), _daily_values(spark, d)), "close marketCap enterpriseVal"),
    sql.out("close marketCap enterpriseVal", "(SELECT bars.*, marketCap, enterpriseVal FROM bars LEFT JOIN (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, max(l_tax) AS marketCap, sum(l_discount) AS enterpriseVal FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) USING (ticker, date))"),
)
_query(
    "delete_range", lambda spark, d: _rounded(universe.delete_where(views.bars(spark, d), F.col("date").between("1994-01-01", "1996-12-31")), "close"),
    sql.out("close", "(SELECT * FROM bars WHERE NOT (date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'))"),
)
_query(
    "purge_dead", lambda spark, d: _rounded(universe.purge(views.bars(spark, d), views.listing(spark, d).withColumn("designation", F.expr("if(ticker % 7 = 0, 'deadTicker', 'active')")), ["ticker"]), "close"),
    sql.out("close", "(SELECT * FROM bars WHERE ticker NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 = 0))"),
)
_query(
    "trend_shares", lambda spark, d: _rounded(signals.trend_shares(views.bars(spark, d).withColumn("prevailingTrend", F.signum(w.change("close")).cast("int")).withColumn("era", w.era())), "share", "era prevailingTrend rows", 6),
    f"""WITH {sql.BARS}, t AS (SELECT CAST(sign(close - {sql.lag("close")}) AS INTEGER) AS prevailingTrend, CAST({" + ".join(f"CASE WHEN date >= DATE '{x}' THEN 1 ELSE 0 END" for x in w.ERA_STARTS)} AS INTEGER) AS era FROM bars)
  SELECT era, prevailingTrend, count(*) AS rows, round(count(*) / sum(count(*)) OVER (PARTITION BY era) + {sql.NUDGE!r}, 6) + CAST(0 AS DOUBLE) AS share FROM t WHERE prevailingTrend IS NOT NULL GROUP BY era, prevailingTrend""",
)
_query(
    "window_hook", lambda spark, d: _rounded(w.windows(views.bars(spark, d), {"top": (F.max, "close", 15), "middle": (F.avg, "volume", 30)}), "top middle"),
    sql.out("top middle", f"(SELECT *, {sql.roll('max', 'close', 15)} AS top, {sql.roll('avg', 'volume', 30)} AS middle FROM bars)"),
)


def _configured(spark: SparkSession, d: str) -> DataFrame:
    """All configured signals on the real swing columns, scored."""
    return signals.score(series.configured(views.bars(spark, d).join(views.listing(spark, d), "ticker"), (signals.TREND, "reversalConf")), list(signals.SIGNALS))


_query("signals_backtest", lambda spark, d: signals.backtest(_configured(spark, d)))
_query("signals_total_score", lambda spark, d: _rounded(signals.total_score(_configured(spark, d)), "totalScore"))
