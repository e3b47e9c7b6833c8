"""Signals: a declarative language over indicator columns, compiled to Column expressions.

A signal names its clauses; all must hold, but a clause whose key ends in a digit is an alternative to the one before. Clause kinds by prefix: threshold,
crossover, failureSwing, divergence, convergence. An operand is a number, a column, or ``Nth``: that percentile of the clause's transformed
feature over the ticker's whole history.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w

TREND = "retracementTrend"


def _t(**x):
    return x


#: Signals by feature column: name without direction, then clauses (fixed parameters).
BULLISH: list[tuple[str, str, dict[str, dict]]] = [
    ("demandIndex", "demandIdx_threshold", {"threshold": _t(above="90th", currentTrend=1)}),
    ("demandIndex", "demandIdx_cross_zero", {"crossover": _t(above=0, currentTrend=-1), "crossover2": _t(below=0, currentTrend=-1)}),
    ("demandIndex", "demandIdx_longterm_divergence", {"divergenceLong": _t(coFeature="close", above="75th", direction=1, length=10, currentTrend=-1)}),
    ("demandIndex", "demandIdx_trend_divergence", {"divergence": _t(coFeature="close", above="80th", trend=20, direction=1, currentTrend=-1)}),
    ("williamsR14", "WPR_divergence", {"threshold": _t(below=-80), "divergence": _t(coFeature="close", above="75th", currentTrend=-1)}),
    ("williamsR14", "WPR_3_period_threshold", {"threshold": _t(below=-80, length=3, currentTrend=-1)}),
    ("macd", "MACD_price_divergence", {"threshold": _t(below="10th"), "divergence": _t(feature="macdHist", coFeature="close", above="85th", trend=19, direction=1, currentTrend=-1)}),
    ("macd", "MACD_crossover_sigline", {"threshold": _t(below="40th"), "crossover": _t(above="macdSig")}),
    ("macd", "MACD_5_period_low", {"threshold": _t(below="5th", length=5)}),
    ("macd", "MACD_cross_above_zero", {"crossover": _t(above=0)}),
    ("cci20", "CCI_trend_reversal", {"thresholdTrend": _t(trend=5, above=0), "threshold": _t(below=-50), "crossover": _t(above="cci20_ma14")}),
    ("cci20", "CCI_divergence", {"threshold": _t(trend=10, above="60th"), "thresholdClose": _t(feature="close", trend=10, below="40th"), "divergence": _t(coFeature="close", above="80th", trend=10, direction=1)}),
    ("rsi14", "RSI_divergence", {"threshold": _t(trend=14, above="60th"), "thresholdClose": _t(feature="close", trend=14, below="40th"), "divergence": _t(coFeature="close", above="80th", trend=14, direction=1)}),
    ("rsi14", "RSI_failure_swing", {"failureSwing": _t(bottom=14, thresh=30, currentTrend=-1)}),
    ("rsi14", "RSI_threshold", {"threshold": _t(below=30, length=2)}),
    ("bollingerSMA20", "bollinger_squeeze", {"thresholdSqueeze": _t(feature="bollingerRange20", zscored=250, below="10th", currentTrend=-1)}),
    ("bollingerSMA20", "bollinger_threshold", {"threshold": _t(feature="close", below="bollingerLower20")}),
    ("kst", "KST_crossover_sigline", {"crossover": _t(above="kstSig"), "threshold": _t(below="20th")}),
    ("kst", "KST_cross_above_zero", {"crossover": _t(above=0)}),
    ("stochasticK20", "stochastic_crossover_D", {"crossover": _t(above="stochasticD20"), "threshold": _t(below=20)}),
    ("stochasticK20", "stochastic_price_divergence", {"divergence": _t(coFeature="close", above="80th", trend=20, direction=-1, currentTrend=-1)}),
    ("adx", "adx_threshold_crossover", {"threshold": _t(above=20), "crossover": _t(feature="dmiPlus", above="dmiMinus")}),
    ("adx", "adx_trend_after_low", {"threshold": _t(below=20), "thresholdADXTrend": _t(trend=10, above="75th"), "thresholdPCFromMin": _t(feature="percentDiffMin", below="25th")}),
    ("psar", "PSAR_below_close", {"crossover": _t(below="close")}),
]
BEARISH: list[tuple[str, str, dict[str, dict]]] = [
    ("demandIndex", "demandIdx_trend_divergence", {"divergence": _t(coFeature="close", above="75th", trend=20, direction=-1, currentTrend=1)}),
    ("demandIndex", "demandIdx_cross_zero", {"crossover": _t(above=0, currentTrend=1), "crossover2": _t(below=0, currentTrend=1)}),
    ("demandIndex", "demandIdx_longterm_divergence", {"divergenceLong": _t(coFeature="close", above="75th", zscored=250, direction=-1, length=10, currentTrend=1)}),
    ("williamsR14", "WPR_divergence", {"threshold": _t(above=-20), "divergence": _t(coFeature="close", above="75th", currentTrend=1)}),
    ("williamsR14", "WPR_3_period_threshold", {"threshold": _t(above=-20, length=3, currentTrend=1)}),
    ("macd", "MACD_price_divergence", {"threshold": _t(above="90th"), "divergence": _t(feature="macdHist", coFeature="close", above="85th", trend=19, direction=-1, currentTrend=1)}),
    ("macd", "MACD_crossover_sigline", {"threshold": _t(above="60th"), "crossover": _t(below="macdSig")}),
    ("macd", "MACD_5_period_high", {"threshold": _t(above="95th", length=5)}),
    ("macd", "MACD_cross_below_zero", {"crossover": _t(below=0)}),
    ("cci20", "CCI_trend_reversal", {"threshold": _t(trend=5, below=0), "threshold2": _t(above=50), "crossover": _t(below="cci20_ma14")}),
    ("cci20", "CCI_divergence", {"threshold": _t(trend=10, below="40th"), "thresholdClose": _t(feature="close", trend=10, above="60th"), "divergence": _t(coFeature="close", above="75th", trend=10, direction=-1)}),
    ("rsi14", "RSI_divergence", {"threshold": _t(trend=14, below="40th"), "thresholdClose": _t(feature="close", trend=14, above="60th"), "divergence": _t(coFeature="close", above="80th", trend=14, direction=-1)}),
    ("rsi14", "RSI_failure_swing", {"failureSwing": _t(top=14, thresh=70, currentTrend=1)}),
    ("rsi14", "RSI_threshold", {"threshold": _t(above=70, length=2)}),
    ("bollingerSMA20", "bollinger_squeeze", {"thresholdSqueeze": _t(feature="bollingerRange20", zscored=250, below="10th", currentTrend=1)}),
    ("bollingerSMA20", "bollinger_threshold", {"threshold": _t(feature="close", above="bollingerUpper20")}),
    ("kst", "KST_crossover_sigline", {"crossover": _t(below="kstSig"), "threshold": _t(above="80th")}),
    ("kst", "KST_cross_below_zero", {"crossover": _t(below=0)}),
    ("stochasticK20", "stochastic_crossover_D", {"crossover": _t(below="stochasticD20"), "threshold": _t(above=80)}),
    ("stochasticK20", "stochastic_price_divergence", {"divergence": _t(coFeature="close", above="80th", trend=20, direction=1, currentTrend=1)}),
    ("adx", "adx_threshold_crossover", {"threshold": _t(above=20), "crossover": _t(feature="dmiMinus", above="dmiPlus")}),
    ("adx", "adx_trend_after_high", {"threshold": _t(below=20), "thresholdADXTrend": _t(trend=10, below="25th"), "thresholdPCFromMax": _t(feature="percentDiffMax", below="25th")}),
    ("psar", "PSAR_above_close", {"crossover": _t(above="close")}),
]
SIGNALS = {f"bullish_{name}": (f, c) for f, name, c in BULLISH} | {f"bearish_{name}": (f, c) for f, name, c in BEARISH}

NTH = re.compile(r"(\d+)(?:st|nd|rd|th)")


@dataclass
class Compiler:
    """Builds the columns of signals in layers: transformed features first, then percentiles over them, then conditions.

    Equal layers of several signals are made once.
    """

    df: DataFrame
    layers: dict[str, str] = field(default_factory=dict)

    def layer(self, label: str, column: Column) -> str:
        name = self.layers.get(label)
        if name is None:
            name = self.layers[label] = f"_s{len(self.layers)}"
            self.df = self.df.withColumn(name, column)
        return name

    def transformed(self, feature: str, trend: int | None, z: int | None) -> str:
        name = feature
        if trend:
            name = self.layer(f"slope({name},{trend})", w.slope(name, trend))
        if z:
            name = self.layer(f"z({name},{z})", w.rolling_zscore(name, z))
        return name

    def operand(self, value, feature: str) -> Column:
        if isinstance(value, str) and value in self.df.columns:
            return F.col(value)
        if isinstance(value, str) and (m := NTH.fullmatch(value)):
            return F.col(self.layer(f"p({feature},{m[1]})", w.percentile(feature, int(m[1]))))
        return F.lit(float(value))

    def threshold(self, feature: str, c: dict) -> Column:
        x = self.transformed(feature, c.get("trend"), c.get("zscored"))
        out = F.lit(True)
        if "above" in c:
            out = out & w.truth(F.col(x) >= self.operand(c["above"], x))
        if "below" in c:
            out = out & w.truth(F.col(x) <= self.operand(c["below"], x))
        return out

    def crossover(self, feature: str, c: dict) -> Column:
        side = "above" if "above" in c else "below"
        other = self.layer(f"operand({feature},{c[side]})", self.operand(c[side], feature))
        a, b = F.col(feature), F.col(other)
        before_a, before_b = w.lag(feature), w.lag(other)
        return w.truth((a >= b) & (before_a <= before_b)) if side == "above" else w.truth((a <= b) & (before_a >= before_b))

    def failure_swing(self, feature: str, c: dict) -> Column:
        kind = "bottom" if "bottom" in c else "top"
        n = c[kind]
        values = self.layer(f"window({feature},{n})", F.when(F.count(F.col(feature)).over(w.frame(n)) == n, F.collect_list(feature).over(w.frame(n))))
        return w.truth(failure_swing(F.col(values), kind, c["thresh"]))

    def divergence(self, feature: str, c: dict, kind: str) -> Column:
        pair = []
        for x in (feature, c["coFeature"]):
            z = self.layer(f"z({x},250)", w.rolling_zscore(x, 250))
            pair.append(self.layer(f"slope({z},{c['trend']})", w.slope(z, c["trend"])) if c.get("trend") else z)
        f, g = map(F.col, pair)
        mask = f > g if c.get("direction") == 1 else f < g
        gap = self.layer(f"gap({pair},{c.get('direction') == 1})", F.when(mask, F.abs(f - g)))
        side = "above" if kind == "divergence" else "below"
        limit = self.operand(c[side], gap)
        return w.truth(F.col(gap) >= limit if side == "above" else F.col(gap) <= limit)

    def clause(self, feature: str, key: str, c: dict) -> Column:
        feature = c.get("feature", feature)
        if key.startswith("threshold"):
            out = self.threshold(feature, c)
        elif key.startswith("crossover"):
            out = self.crossover(feature, c)
        elif key.startswith("failureSwing"):
            out = self.failure_swing(feature, c)
        else:
            out = self.divergence(feature, c, "divergence" if key.startswith("divergence") else "convergence")
        if "length" in c:
            flag = self.layer(f"flag({feature},{key},{sorted(c.items(), key=str)})", out)
            out = w.held(F.col(flag), c["length"])
        if "currentTrend" in c:
            out = out & w.truth(F.col(TREND) == c["currentTrend"])
        return out

    def signal(self, feature: str, clauses: dict[str, dict]) -> Column:
        parts: list[Column] = []
        for key, c in clauses.items():
            one = self.clause(feature, key, c)
            if parts and key[-1].isdigit():
                parts[-1] = parts[-1] | one
            else:
                parts.append(one)
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out


def failure_swing(values: Column, kind: str, limit: float) -> Column:
    """Whether the last but one value of the window is its lowest valley after a minimum at or under the limit (for ``top``, mirrored).

    Valleys are sought from three rows after the first minimum; the first of them is compared with the window's last value too.
    """
    sign = 1.0 if kind == "bottom" else -1.0
    x = F.transform(values, lambda v: v * F.lit(sign))
    extreme = F.array_min(x)
    start = F.array_position(x, extreme) + 3  # 1-based place of the first value looked at
    rest = F.slice(x, start.cast("int"), F.greatest(F.size(x) - start + 1, F.lit(0)).cast("int"))
    before = lambda i: F.when(i == 0, F.element_at(x, -1)).otherwise(F.get(rest, i - 1))
    valleys = F.filter(F.transform(rest, lambda v, i: F.when((v < F.get(rest, i + 1)) & (v < before(i)), v)), lambda v: v.isNotNull())
    return (extreme <= F.lit(sign * limit)) & (F.size(rest) > 1) & (F.get(x, F.size(x) - 2) == F.array_min(valleys))


def compile_signals(df: DataFrame, signals: dict[str, tuple[str, dict]] | None = None) -> DataFrame:
    """Adds a Boolean column for each signal; ``df`` has ticker, date, the indicator columns and retracementTrend."""
    c = Compiler(w.indexed(df))
    for name, (feature, clauses) in (signals or SIGNALS).items():
        column = c.signal(feature, clauses)
        c.df = c.df.withColumn(name, column)
    return c.df.drop("row_index", *c.layers.values())


def turn(name: str) -> Column:
    """Whether a signal stands against the trend (rev) or with it (cont)."""
    against = -1 if name.startswith("bullish") else 1
    return F.when(F.col(TREND) == against, "rev").otherwise("cont")


#: Scores of a signal whose success is not known.
DEFAULTS = {"rev": 0.5, "cont": 0.25}


def score(df: DataFrame, names: list[str], rates: DataFrame | None = None) -> DataFrame:
    """Replaces each signal column by ``{name}_sig``: its rate of success where known, else the default; negative for bearish; 0 without signal.

    ``rates`` (sector, signalName, reversal, continuation) has a row for each sector and signal, a bounded table that is broadcast once as a map.
    """
    if rates is not None:
        known = rates.groupBy("sector").agg(F.map_from_entries(F.collect_list(F.struct(F.regexp_replace("signalName", "_sig$", ""), F.struct("reversal", "continuation")))).alias("_rates"))
        df = df.join(F.broadcast(known), "sector", "left")
    found = {}
    for name in names:
        sign = 1.0 if name.startswith("bullish") else -1.0
        value = F.when(turn(name) == "rev", sign * DEFAULTS["rev"]).otherwise(sign * DEFAULTS["cont"])
        if rates is not None:
            own = F.try_element_at("_rates", F.lit(name))
            value = F.coalesce(F.when(turn(name) == "rev", own["reversal"]).otherwise(own["continuation"]), value)
        found[f"{name}_sig"] = F.when(F.col(name), value).otherwise(0.0)
    df = df.withColumns(found)
    return df.drop(*names, *(["_rates"] if rates is not None else []))


def total_score(df: DataFrame, n: int = 3) -> DataFrame:
    """Adds totalScore: the mean over n rows of the sum of all ``_sig`` columns."""
    columns = [c for c in df.columns if c.endswith("_sig")]
    df = df.withColumn("_sum", sum((F.col(c) for c in columns), F.lit(0.0)))
    return df.withColumn("totalScore", w.mean("_sum", n)).drop("_sum")


def backtest(df: DataFrame, ahead: int = 60) -> DataFrame:
    """Counts, successes and failures of each ``_sig`` column for each ticker.

    A reversal succeeds if the row or one of the ``ahead`` rows after it confirms its direction, a continuation if none of them confirms any.
    """
    columns = [c for c in df.columns if c.endswith("_sig")]
    own = ["ticker", "sector", "cap", "exchange"]
    # only what fired travels to its ticker, signals by their place
    entries = F.array(*(F.struct(F.lit(i).alias("signal"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)))
    df = df.select(*own, "date", TREND, "reversalConf", F.filter(entries, lambda x: x["v"] != 0).alias("_fired"))
    # rows of the frame as a difference of running counts, so the cost does not grow with it
    upto = w.ordered().rowsBetween(Window.unboundedPreceding, ahead)
    rows = lambda x: F.count(F.when(x, 1)).over(upto) - F.count(F.when(x, 1)).over(w.before(1))
    confirmed = F.col("reversalConf")
    hit = lambda x: F.when(rows(confirmed.isNotNull()) > 0, rows(confirmed == x) > 0)
    df = df.withColumns({"_up": hit("toUp"), "_down": hit("toDown"), "_last": F.col("date") == F.max("date").over(Window.partitionBy(*own))})
    # a ticker's last row stands for signals that never fired, so no second branch has to be joined
    silent = F.array(*(F.struct(F.lit(i).alias("signal"), F.lit(0.0).alias("v")) for i in range(len(columns))))
    long = df.select(*own, "date", TREND, "_up", "_down", F.explode(F.when(F.col("_last"), F.concat("_fired", silent)).otherwise(F.col("_fired"))).alias("x")).select("*", "x.signal", "x.v").drop("x")
    up = [i for i, c in enumerate(columns) if c.startswith("bullish")]
    bullish = F.col("signal").isin(up)
    fires = F.when(bullish, F.col("v") > 0).otherwise(F.col("v") < 0)
    against = F.col(TREND) == F.when(bullish, -1).otherwise(1)
    turned = F.when(bullish, F.col("_up")).otherwise(F.col("_down"))
    quiet = ~F.col("_up") & ~F.col("_down")
    rev, cont = fires & against, fires & ~against
    counts = {"reversalCount": rev, "reversalSuccess": rev & turned, "reversalFailure": rev & ~turned, "continuationCount": cont, "continuationSuccess": cont & quiet, "continuationFailure": cont & ~quiet}
    part = F.split("signalName", "_")
    indicator = F.when(F.substring("signalName", 8, 1) == "_", F.get(part, F.lit(1))).otherwise("candlestick")
    out = long.groupBy(*own, "signal").agg(F.max("date").alias("date"), *(F.count_if(c).cast("long").alias(n) for n, c in counts.items()))
    out = out.withColumn("signalName", F.get(F.array(*map(F.lit, columns)), F.col("signal")))
    return out.select("date", *own, indicator.alias("indicator"), "signalName", *counts)


def success_rates(results: DataFrame) -> DataFrame:
    """Mean over tickers of success by sector and signal; bearish rates are negative; unknown ones 0."""
    sign = F.when(F.col("signalName").startswith("bearish"), -1.0).otherwise(1.0)
    rate = lambda kind: F.coalesce(F.avg(F.try_divide(F.col(f"{kind}Success").cast("double"), F.col(f"{kind}Count").cast("double"))), F.lit(0.0))
    means = results.groupBy("sector", "signalName").agg(rate("reversal").alias("reversal"), rate("continuation").alias("continuation"))
    return means.select("sector", "signalName", (F.col("reversal") * sign).alias("reversal"), (F.col("continuation") * sign).alias("continuation"))


def backtest_due(day, last_run) -> bool:
    """Whether a backtest should run: on Fridays and Saturdays, 28 days or more after the last, or if there was none."""
    return last_run is None or (day.weekday() in (4, 5) and (day - last_run).days >= 28)




def trend_shares(df: DataFrame, trend: str = "prevailingTrend", by: str = "era") -> DataFrame:
    """Share of each value of the trend among the known ones of an era."""
    counts = df.where(F.col(trend).isNotNull()).groupBy(by, trend).agg(F.count("*").alias("rows"))
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy(by)))  # a row for each era and value
