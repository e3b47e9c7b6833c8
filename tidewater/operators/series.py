"""All configured signals of one ticker in one grouped pass over its bars.

The measures are those of ``indicators`` and ``windows``, on numpy arrays instead of Columns and in the same order of operations; a test holds both
against each other. A wide plan of windows moves and buffers every column once for each of its layers and goes over a frame of 250 rows anew for
every row; here only bars travel in, and only what is asked for travels out. Null is NaN, comparisons with it are false. A ticker's series is bounded by
its trading days, so it fits a task; frames are laid out ``_ROWS`` rows at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import recursive, signals
from .indicators import EXTREME_SHORT, EXTREME_WINDOW, KST
from .recursive import Series

_ROWS = 4096


def _shift(x: np.ndarray, n: int = 1) -> np.ndarray:
    out = np.full(x.size, np.nan)
    out[n:] = x[: max(0, x.size - n)]
    return out


def _divide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(a.size, np.nan), where=b != 0)


def _framed(f, x: np.ndarray, n: int) -> np.ndarray:
    """``f`` of the frames of n rows, null unless all n are known."""
    out = np.full(x.size, np.nan)
    if x.size >= n:
        frames = np.lib.stride_tricks.sliding_window_view(x, n)
        for i in range(0, len(frames), _ROWS):
            out[n - 1 + i : n - 1 + i + _ROWS][: len(frames) - i] = f(frames[i : i + _ROWS])
    return out


def high(x: np.ndarray, n: int) -> np.ndarray:
    return _framed(lambda v: v.max(1), x, n)


def low(x: np.ndarray, n: int) -> np.ndarray:
    return _framed(lambda v: v.min(1), x, n)


def total(x: np.ndarray, n: int) -> np.ndarray:
    """Added in the order of the rows."""
    out = np.full(x.size, np.nan)
    if x.size >= n:
        m = x.size - n + 1
        own = x[:m].copy()
        for i in range(1, n):
            own += x[i : i + m]
        out[n - 1 :] = own
    return out


def mean(x: np.ndarray, n: int) -> np.ndarray:
    return total(x, n) / n


def _since(x: np.ndarray, n: int) -> np.ndarray:
    """Sum over the last n rows as a difference of running sums."""
    running = np.cumsum(x)
    out = running.copy()
    out[n:] -= running[:-n]
    return out


def _known(x: np.ndarray, n: int) -> np.ndarray:
    return _since((~np.isnan(x)).astype(np.int64), n) == n


def deviation(x: np.ndarray, n: int) -> np.ndarray:
    """Sample standard deviation; 0 where all values are equal, whatever the rounding of their mean."""

    def spread(v):
        v = v - v.mean(1, keepdims=True)
        return np.sqrt(np.einsum("ij,ij->i", v, v) / (n - 1))

    out = _framed(spread, x, n)
    same = np.zeros(x.size, np.int64)
    same[1:] = x[1:] == x[:-1]
    out[_since(same, n - 1) == n - 1] = 0.0
    return out


def zscore(x: np.ndarray, n: int) -> np.ndarray:
    centre = np.where(_known(x, n), _since(np.nan_to_num(x), n) / n, np.nan)
    return _divide(x - centre, deviation(x, n))


def rolling_zscore(x: np.ndarray, window: int = 250, short: int = 120) -> np.ndarray:
    return zscore(x, short if x.size <= window else window)


def slope(x: np.ndarray, n: int) -> np.ndarray:
    i, known = np.arange(x.size, dtype=float), np.nan_to_num(x)
    found = (_since(known * i, n) - (i - (n - 1) / 2) * _since(known, n)) / (n * (n * n - 1) / 12)
    return np.where(_known(x, n), found, np.nan)


def percentile(ranked: np.ndarray, percent: float) -> float:
    """Of known values in ascending order, interpolated."""
    if not ranked.size:
        return np.nan
    at = (ranked.size - 1) * (percent / 100)
    lower, upper = int(np.floor(at)), int(np.ceil(at))
    a, b = float(ranked[lower]), float(ranked[upper])
    return a if lower == upper or a == b else (upper - at) * a + (at - lower) * b


def demand_pressure(s: Series, period: int = 10, price_range: int = 2) -> Series:
    volume = s["volume"]
    spread = mean(high(s["high"], price_range) - low(s["low"], price_range), period)
    move = _divide(s["close"] - s["open"], s["open"]) * _divide(3 * s["close"], spread)
    other, up = _divide(volume, move), s["close"] > s["open"]
    buying, selling = np.where(up, volume, other), np.where(up, other, volume)
    raw = np.where(np.abs(buying) > np.abs(selling), _divide(selling, buying), _divide(buying, selling))
    return {"demandRaw": np.where((move == 0) & (volume > 0), 0.0, raw)}


def williams_r(s: Series, n: int = 14) -> Series:
    top, bottom = high(s["high"], n), low(s["low"], n)
    return {f"williamsR{n}": _divide(top - s["close"], top - bottom) * -100}


def cci(s: Series, n: int = 20, smooth: int = 14) -> Series:
    typical = (s["high"] + s["low"] + s["close"]) / 3
    centre = mean(typical, n)
    spread = np.zeros(typical.size)
    for back in range(n - 1, -1, -1):
        spread += np.abs(_shift(typical, back) - centre)
    value = _divide(typical - centre, 0.015 * (spread / n))
    return {f"cci{n}": value, f"cci{n}_ma{smooth}": total(value, smooth) / smooth}


def bollinger(s: Series, n: int = 20, width: float = 2.0) -> Series:
    centre, spread = mean(s["close"], n), deviation(s["close"], n)
    upper, lower = centre + width * spread, centre - width * spread
    return {f"bollingerSMA{n}": centre, f"bollingerUpper{n}": upper, f"bollingerLower{n}": lower, f"bollingerRange{n}": upper - lower}


def kst(s: Series, signal: int = 9) -> Series:
    rates = []
    for roc, smooth, weight in KST:
        before = _shift(s["close"], roc)
        rates.append(mean(_divide(s["close"] - before, before) * 100, smooth) * weight)
    line = sum(rates[1:], rates[0])
    return {"kst": line, "kstSig": mean(line, signal)}


def stochastic(s: Series, n: int = 20, smooth: int = 3) -> Series:
    top, bottom = high(s["high"], n), low(s["low"], n)
    value = _divide(s["close"] - bottom, top - bottom) * 100
    return {f"stochasticK{n}": value, f"stochasticD{n}": mean(value, smooth)}


def extremes_distance(s: Series) -> Series:
    close = s["close"]
    if close.size < EXTREME_SHORT:
        return {x: np.full(close.size, np.nan) for x in ("percentDiffMax", "percentDiffMin")}
    n = EXTREME_SHORT if close.size <= EXTREME_WINDOW else EXTREME_WINDOW
    far = {"percentDiffMax": high(s["high"], n), "percentDiffMin": low(s["low"], n)}
    return {name: _divide(np.abs(close - x), (close + x) / 2) * 100 for name, x in far.items()}


def on_balance_volume(s: Series, n: int = 10) -> Series:
    return {"OBV": total(np.nan_to_num(np.sign(s["close"] - _shift(s["close"]))) * s["volume"], n)}


#: What the configured signals read, in an order in which each finds what it needs.
WINDOWED = (demand_pressure, williams_r, cci, bollinger, kst, stochastic, extremes_distance, on_balance_volume)
RECURSIVE = ("atr", "macd", "demand_index", "rsi", "adx", "psar", "trend_score", "swing_confirmation")
BARS = ("open", "high", "low", "close", "volume")


def technicals(s: Series) -> Series:
    """Every column that a configured signal reads, of one ticker's bars in ascending order of time."""
    s = dict(s)
    for f in WINDOWED:
        s |= f(s)
    for name in RECURSIVE:
        s |= recursive.MEASURES[name][0](s)
    made = {c for name in RECURSIVE for c in recursive.MEASURES[name][2]} - recursive.TEXT
    return s | {c: np.where(np.isinf(s[c]), np.nan, s[c]) for c in made}


def failure_swing(x: np.ndarray, n: int, kind: str, limit: float) -> np.ndarray:
    """As ``signals.failure_swing``, of the last n rows."""
    sign = 1.0 if kind == "bottom" else -1.0

    def found(v):
        v = v * sign
        extreme, start = v.min(1), v.argmin(1)[:, None] + 3
        at = np.arange(n - 1)
        before = np.where(at == start, v[:, -1:], np.concatenate([v[:, :1], v[:, :-2]], 1))
        valley = (at >= start) & (v[:, :-1] < v[:, 1:]) & (v[:, :-1] < before)
        lowest = np.where(valley, v[:, :-1], np.inf).min(1)
        return (extreme <= sign * limit) & valley.any(1) & (v[:, -2] == lowest)

    return (_framed(found, x, n) == 1) & _known(x, n)


class Evaluator:
    """Signals of one ticker, in the layers of ``signals.Compiler``; equal layers are made once."""

    def __init__(self, s: Series):
        self.s, self.layers = s, {}

    def layer(self, key: tuple, make) -> np.ndarray:
        found = self.layers.get(key)
        if found is None:
            found = self.layers[key] = make()
        return found

    def values(self, key: tuple) -> np.ndarray:
        """A column, or a layer over one: ("z" or "slope", what it is over, rows)."""
        if len(key) == 1:
            return self.s[key[0]]
        return self.layer(key, lambda: (rolling_zscore if key[0] == "z" else slope)(self.values(key[1]), key[2]))

    def operand(self, value, key: tuple, x: np.ndarray):
        if isinstance(value, str) and value in self.s:
            return self.s[value]
        if isinstance(value, str) and (m := signals.NTH.fullmatch(value)):
            return percentile(self.layer(("ranked", key), lambda: np.sort(x[~np.isnan(x)])), int(m[1]))
        return float(value)

    def threshold(self, feature: str, c: dict) -> np.ndarray:
        key: tuple = (feature,)
        if c.get("trend"):
            key = ("slope", key, c["trend"])
        if c.get("zscored"):
            key = ("z", key, c["zscored"])
        x = self.values(key)
        out = np.ones(x.size, bool)
        if "above" in c:
            out &= x >= self.operand(c["above"], key, x)
        if "below" in c:
            out &= x <= self.operand(c["below"], key, x)
        return out

    def crossover(self, feature: str, c: dict) -> np.ndarray:
        side = "above" if "above" in c else "below"
        a = self.s[feature]
        b = np.broadcast_to(self.operand(c[side], (feature,), a), a.shape)
        before_a, before_b = _shift(a), _shift(b)
        return (a >= b) & (before_a <= before_b) if side == "above" else (a <= b) & (before_a >= before_b)

    def divergence(self, feature: str, c: dict, kind: str) -> np.ndarray:
        pair: list[tuple] = [("z", (x,), 250) for x in (feature, c["coFeature"])]
        if c.get("trend"):
            pair = [("slope", x, c["trend"]) for x in pair]
        over = c.get("direction") == 1
        f, g = map(self.values, pair)
        key = ("gap", *pair, over)
        gap = self.layer(key, lambda: np.where(f > g if over else f < g, np.abs(f - g), np.nan))
        limit = self.operand(c["above" if kind == "divergence" else "below"], key, gap)
        return gap >= limit if kind == "divergence" else gap <= limit

    def clause(self, feature: str, key: str, c: dict) -> np.ndarray:
        feature = c.get("feature", feature)
        if key.startswith("threshold"):
            out = self.threshold(feature, c)
        elif key.startswith("crossover"):
            out = self.crossover(feature, c)
        elif key.startswith("failureSwing"):
            kind = "bottom" if "bottom" in c else "top"
            out = failure_swing(self.s[feature], c[kind], kind, c["thresh"])
        else:
            out = self.divergence(feature, c, "divergence" if key.startswith("divergence") else "convergence")
        if "length" in c:
            out = _since(out.astype(np.int64), c["length"]) == c["length"]
        if "currentTrend" in c:
            out = out & (self.s[signals.TREND] == c["currentTrend"])
        return out

    def signal(self, feature: str, clauses: dict[str, dict]) -> np.ndarray:
        parts: list[np.ndarray] = []
        for key, c in clauses.items():
            one = self.clause(feature, key, c)
            if parts and key[-1].isdigit():
                parts[-1] = parts[-1] | one
            else:
                parts.append(one)
        return np.logical_and.reduce(parts)


def configured(bars: DataFrame, keep: tuple[str, ...] = (), wanted: dict[str, tuple[str, dict]] | None = None, key: str = "ticker", time: str = "date") -> DataFrame:
    """A Boolean column for each signal, beside the columns of ``bars`` that are no measures and the measures named in ``keep``.

    ``bars`` has ticker, date, open, high, low, close and volume. Unknown prices are null; a ticker without rows gives none; other columns travel unchanged.
    """
    wanted = signals.SIGNALS if wanted is None else wanted
    carried = [c for c in bars.columns if c not in BARS]

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column(time).to_numpy(), kind="stable")
        s = {c: table.column(c).to_numpy().astype(float)[order] for c in BARS}
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            s = technicals(s)
            found = Evaluator(s)
            columns = [found.signal(feature, clauses) for feature, clauses in wanted.values()]
        kept = [pa.array(s[c], pa.string()) if c in recursive.TEXT else pa.array(s[c], pa.float64(), from_pandas=True) for c in keep]
        rows = table.select(carried).take(order)
        return pa.table([*rows.columns, *kept, *map(pa.array, columns)], names=[*carried, *keep, *wanted])

    kinds = {f.name: f.dataType.simpleString() for f in bars.schema}
    schema = [f"`{c}` {kinds[c]}" for c in carried] + [f"`{c}` {'string' if c in recursive.TEXT else 'double'}" for c in keep] + [f"`{c}` boolean" for c in wanted]
    return bars.groupBy(key).applyInArrow(run, ", ".join(schema))
