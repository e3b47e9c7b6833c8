"""Candlestick patterns as Boolean columns.

Cut-offs are percentiles over a ticker's whole history. A pattern is a list of conditions over today's and earlier rows; an unknown
operand makes it false. Names end in the number of rows back: ``c2`` is the close two rows ago.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w

#: Cut-offs: name, measure and percentile (fixed values).
CUTOFFS = {
    "LG": ("up_body", 60), "SG": ("up_body", 40), "LR": ("down_body", 60), "SR": ("down_body", 40),
    "DJ": ("body_size", 7.5), "PM": ("body_size", 4),
    "LU": ("upper_tail", 80), "SU": ("upper_tail", 20), "LL": ("lower_tail", 80), "SL": ("lower_tail", 20),
}

#: Patterns as conditions that all hold; {x} stands for an absolute value (fixed definitions).
PATTERNS: dict[str, str] = {
    "bullishBreakaway": "o4-c4>=LR, o3-c3<=SR, o3>c3, o1-c1<=SR, o1>c1, c>o, c4>o3, c1<c3, c1<m2, c4>c, c>o3",
    "bullishLadder": "o4-c4>=LR, o3-c3>=LR, o2-c2>=LR, c1<o1, c>o, o4>o3, o3>o2, o2>o1, c4>c3, c3>c2, c2>c1, h1-o1>o1-c1, o>o1, c>h1",
    "bearishBreakaway": "c4-o4>=LG, c3-o3<=SG, o3<c3, c1-o1<=SG, o1<c1, c<o, c4<o3, c1>c3, c1>m2, c4<c, c<o3",
    "bearishLadder": "c4-o4>=LG, c3-o3>=LG, c2-o2>=LG, c1>o1, c<o, o4<o3, o3<o2, o2<o1, c4<c3, c3<c2, c2<c1, o1-l1>c1-o1, o<o1, c<l1",
    "bullishStickSandwich": "c2<o2, o1>c2, c1>o2, o2>o1, o>o1, c<o, {c-c2}<=PM",
    "bullishUniqueThreeRivers": "o2-c2>=LR, c1>c2, c1<o1, o1<o2, l1<l2, c-o<=SG, c>o, o>l1",
    "bullishMorningStar": "o2-c2>=LR, {c1-o1}<=SG, c-o>=LG, c2>o1, c2>c1, c1<o, o>o1, c>m2",
    "bullishTriStar": "{c2-o2}<=DJ, {c1-o1}<=DJ, {c-o}<=DJ, m1<l2, m1<l",
    "bullishThreeWhiteSoldiers": "o2<o1, o1<o, c2<c1, c1<c, h2-c2<=SU, h1-c1<=SU, h-c<=SU",
    "bearishThreeBlackCrows": "o2>o1, o1>o, c2>c1, c1>c, c2-l2<=SL, c1-l1<=SL, c-l<=SL",
    "bearishEveningStar": "c2-o2>=LG, {c1-o1}<=SG, o-c>=LR, c2<o1, c2<c1, c1>o, o<o1, c<m2",
    "bearishTriStar": "{c2-o2}<=DJ, {c1-o1}<=DJ, {c-o}<=DJ, m1>h2, m1>h",
    "bullishEngulfing": "c>o1, o1>c1, c1>o",
    "bullishMeetingLines": "o1-c1>=LR, c>o, {c-c1}<=PM",
    "bullishHarami": "o1-c1>=LR, o1>c, c>o, o>c1",
    "bullishHaramiCross": "o1-c1>=LR, {c-o}<=DJ, o1>m, c1<m",
    "bullishPiercingLine": "o1-c1>=LR, o<c1, c>m1",
    "bullishKicking": "c1<o1, c>o, h1-o1<=SU, h-c<=SU, c1-l1<=SL, o-l<=SL, o1<o",
    "bullishHomingPigeon": "o1-c1>=LR, o-c<=SR, o>c, o1>o, c1<c",
    "bullishMatchingLow": "c1<o1, c<o, {c1-c}<=PM",
    "bullishDojiStar": "o1-c1>=LR, {c-o}<=DJ, m<c1",
    "bearishShootingStar": "m>c1, c1>o1, {c-o}<=SG, o-l<=SL | c-l<=SL, h-o>=LU | h-c>=LU",
    "bearishEngulfing": "c1>o1, c<o, c1<o, o1>c",
    "bearishMeetingLines": "c1-o1>=LG, c<o, {c-c1}<=PM",
    "bearishHarami": "c1-o1>=LG, o1<c, c<o, o<c1",
    "bearishHaramiCross": "c1-o1>=LG, {c-o}<=DJ, o1<m, c1>m",
    "bearishDarkCloudCover": "c1-o1>=LG, o>c1, c<m1",
    "bearishKicking": "c1>o1, c<o, h1-c1<=SU, h-o<=SU, o1-l1<=SL, c-l<=SL, o1>o",
    "bearishMatchingHigh": "c1>o1, c>o, {c1-c}<=PM",
    "bullishBeltHold": "c-o>=LG, h-c>=SU, o-l<=SL",
    "bullishInvertedHammer": "{c-o}<=SG, o-l<=SL | c-l<=SL, h-o>=LU | h-c>=LU",
    "bullishHammer": "c1>c, {c-o}<=SG, h-o<=SU | h-c<=SU, o-l>=LL | c-l>=LL",
    "bearishBeltHold": "o-c>=LR, h-o<=SU, c-l>=SL",
    "bearishHangingMan": "c1<c, {c-o}<=SG, h-o<=SU | h-c<=SU, o-l>=LL | c-l>=LL",
}


def cutoffs(df: DataFrame) -> DataFrame:
    """Adds the body, tails, midpoint and the ticker's cut-offs."""
    body = F.col("close") - F.col("open")
    measures = {
        "up_body": F.when(body >= 0, body),
        "down_body": F.when(body < 0, -body),
        "body_size": F.abs(body),
        "upper_tail": F.col("high") - F.greatest("open", "close"),
        "lower_tail": F.least("open", "close") - F.col("low"),
    }
    df = df.withColumns(measures | {"m": (F.col("open") + F.col("close")) / 2})
    return df.withColumns({name: w.percentile(measure, p) for name, (measure, p) in CUTOFFS.items()}).drop(*measures)


def _sql(condition: str) -> str:
    return condition.replace("{", "abs(").replace("}", ")").replace("|", "OR")


def condition(text: str) -> Column:
    """A pattern's conditions as one column, false where unknown."""
    return reduce(lambda a, b: a & b, (w.truth(F.expr(_sql(x))) for x in text.split(", ")))


def candles(df: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """Adds a Boolean column for each pattern."""
    patterns = patterns or PATTERNS
    names = {"o": "open", "h": "high", "l": "low", "c": "close", "m": "m"}
    base = cutoffs(df)
    shifted = {x: F.col(c) for x, c in names.items() if x != "m"}
    shifted |= {f"{x}{n}": w.lag(c, n) for x, c in names.items() for n in range(1, 5)}
    wide = base.withColumns(shifted)
    found = wide.select(*df.columns, *(condition(text).alias(name) for name, text in patterns.items()))
    return found


def candles_sql(bars: str, patterns: dict[str, str] | None = None) -> str:
    """The same patterns as SQL over the relation ``bars``."""
    patterns = patterns or PATTERNS
    part = "PARTITION BY ticker"
    measures = "CASE WHEN close >= open THEN close - open END AS up_body, CASE WHEN close < open THEN open - close END AS down_body, abs(close - open) AS body_size, high - greatest(open, close) AS upper_tail, least(open, close) - low AS lower_tail, (open + close) / 2 AS m"
    cuts = ", ".join(f"quantile_cont({x}, {p / 100}) OVER ({part}) AS {name}" for name, (x, p) in CUTOFFS.items())
    names = {"o": "open", "h": "high", "l": "low", "c": "close", "m": "m"}
    lags = ", ".join(f"lag({c}, {n}) OVER ({part} ORDER BY date) AS {x}{n}" for x, c in names.items() for n in range(1, 5))
    tests = ", ".join("(" + " AND ".join(f"coalesce({_sql(x)}, false)" for x in text.split(", ")) + f") AS {name}" for name, text in patterns.items())
    return f"SELECT ticker, date, {tests} FROM (SELECT *, open AS o, high AS h, low AS l, close AS c, {cuts}, {lags} FROM (SELECT *, {measures} FROM {bars}))"
