"""DuckDB SQL that states the same measures over the same tables, for comparison."""

from __future__ import annotations

BARS = """bars AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i FROM (
  SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, first(px ORDER BY l_orderkey, l_linenumber, l_partkey) AS open, max(px) AS high, min(px) AS low,
         last(px ORDER BY l_orderkey, l_linenumber, l_partkey) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS px FROM lineitem) GROUP BY l_suppkey, CAST(l_shipdate AS DATE)))"""

LISTING = """listing AS (SELECT s_suppkey AS ticker, n_name AS exchange, r_name AS sector,
  CASE WHEN c IS NULL THEN 'Unknown' WHEN c >= 2e11 THEN 'Mega' WHEN c >= 1e10 THEN 'Large' WHEN c >= 2e9 THEN 'Mid' WHEN c >= 3e8 THEN 'Small' ELSE 'Micro' END AS cap
  FROM (SELECT *, s_acctbal * 3e7 AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey))"""

TRAFFIC = """traffic AS (SELECT *, count(*) OVER (PARTITION BY datetime) AS volume, CAST(hour(datetime) * 4 + minute(datetime) // 15 AS DOUBLE) AS interval_index FROM (
  SELECT event_id AS id, date_trunc('hour', ts) + to_minutes(CAST(minute(ts) // 15 * 15 AS INTEGER)) AS datetime, event_type AS vehicle_type, CAST(value AS DOUBLE) AS velocity,
         60.0 / nullif(CAST(value AS DOUBLE), 0) * 5 AS travel_time, CAST(event_type = 'error' AS INTEGER) AS accident FROM events))"""

#: Added before rounding, so that halves round alike in two engines.
NUDGE = 1.3e-7

ORDER = "PARTITION BY ticker ORDER BY date"


def frame(n: int) -> str:
    return f"({ORDER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(f: str, x: str, n: int) -> str:
    return f"(CASE WHEN count({x}) OVER {frame(n)} = {n} THEN {f}({x}) OVER {frame(n)} END)"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({ORDER})"


def slope(x: str, n: int) -> str:
    return f"(CASE WHEN count({x}) OVER {frame(n)} = {n} THEN regr_slope({x}, i) OVER {frame(n)} END)"


def z(x: str, n: int) -> str:
    return f"(({x} - {roll('avg', x, n)}) / nullif({roll('stddev_samp', x, n)}, 0))"


def rolling_z(x: str) -> str:
    return f"(CASE WHEN count(*) OVER (PARTITION BY ticker) <= 250 THEN {z(x, 120)} ELSE {z(x, 250)} END)"


def percentile(x: str, p: float) -> str:
    return f"(quantile_cont({x}, {p / 100}) OVER (PARTITION BY ticker))"


_RUN = f"({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def ewm(x: str, alpha: float, least: int = 1) -> str:
    """Adjusted exponential mean as a quotient of weighted sums."""
    q = f"pow({1 / (1 - alpha)!r}, i)"
    return f"(CASE WHEN count({x}) OVER {_RUN} >= {least} THEN sum({x} * {q}) OVER {_RUN} / sum(CASE WHEN {x} IS NOT NULL THEN {q} END) OVER {_RUN} END)"


def wilder(relation: str, x: str, alpha: float, least: int, out: str) -> str:
    """Relation with column ``out``: the unadjusted exponential mean of x, which has no gaps after its first value."""
    q = f"pow({1 / (1 - alpha)!r}, i)"
    first = f"(SELECT *, min(CASE WHEN {x} IS NOT NULL THEN i END) OVER (PARTITION BY ticker) AS i_{out} FROM {relation})"
    value = f"sum({x} * {q} * CASE WHEN i = i_{out} THEN 1.0 ELSE {alpha!r} END) OVER {_RUN} / {q}"
    return f"(SELECT *, CASE WHEN count({x}) OVER {_RUN} >= {least} THEN {value} END AS {out} FROM {first})"


def out(columns: str | list[str], relation: str, ctes: str = BARS, keys: str = "ticker, date", digits: int = 4) -> str:
    """Rounded columns of a relation."""
    names = columns.split() if isinstance(columns, str) else columns
    return f"WITH RECURSIVE {ctes} SELECT {keys}, {', '.join(f'round(CAST({c} AS DOUBLE) + {NUDGE!r}, {digits}) + CAST(0 AS DOUBLE) AS {c}' for c in names)} FROM {relation}"
