"""The views of sources.market as DuckDB common table expressions, and the rounding that both sides share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = 6

QUOTES = """quotes AS (
  SELECT ts, event_id, 1000.0::DOUBLE + value * 0.05::DOUBLE AS bid,
         1000.0::DOUBLE + value * 0.05::DOUBLE + 0.2::DOUBLE + CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0::DOUBLE AS ask
  FROM events)"""


def bars_sql(minutes: int = 15, name: str = "bars") -> str:
    side = lambda s: f"first({s} ORDER BY ts, event_id) AS open_{s}, max({s}) AS high_{s}, min({s}) AS low_{s}, last({s} ORDER BY ts, event_id) AS close_{s}"
    return f"{name} AS (SELECT time_bucket(INTERVAL '{minutes} minutes', ts) AS bar, {side('bid')}, {side('ask')}, count(*) AS quote_count FROM quotes GROUP BY 1)"


BARS = QUOTES + ", " + bars_sql()

FEED_B = """feed_b AS (
  SELECT bar, open_bid + 0.0005::DOUBLE AS open_bid, high_bid + 0.0005::DOUBLE AS high_bid, low_bid + 0.0005::DOUBLE AS low_bid, close_bid + 0.0005::DOUBLE AS close_bid,
         open_ask, high_ask, low_ask, close_ask, quote_count
  FROM bars WHERE (epoch(bar)::BIGINT // 900) % 7 <> 0)"""

DAILY = """daily0 AS (
  SELECT o_orderdate::DATE AS date, substr(o_orderpriority, 1, 1) AS p, power(ln(o_totalprice) - 11, 2) AS v FROM orders WHERE isodow(o_orderdate) < 6),
daily AS (SELECT *, a + l + r AS d FROM (
  SELECT date, sum(v) FILTER (p IN ('1', '2')) AS a, sum(v) FILTER (p = '3') AS l, sum(v) FILTER (p NOT IN ('1', '2', '3')) AS r FROM daily0 GROUP BY date))"""

TRADES = """trades AS (
  SELECT l_suppkey AS book, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity) AS n, l_shipdate::DATE AS exit_date,
         ((l_partkey % 41) - 19)::DOUBLE / 10.0::DOUBLE AS r, 1 + l_quantity / 10.0::DOUBLE AS risk,
         CASE WHEN l_returnflag = 'R' THEN 'short' ELSE 'long' END AS direction, 15 * l_quantity AS minutes
  FROM lineitem)"""

#: Bars with mid prices and the quality flags at the thresholds that the queries use.
FLAGGED = (
    BARS
    + """, flagged0 AS (
  SELECT *, (open_bid + open_ask) / 2 AS mid_open, (close_bid + close_ask) / 2 AS mid_close, open_ask - open_bid AS spread_open, close_ask - close_bid AS spread_close,
         high_bid = low_bid AND high_ask = low_ask AS flat FROM bars),
flagged AS (
  SELECT *, coalesce(spread_open <= 0 OR spread_close <= 0, false) AS spread_bad, coalesce(greatest(spread_open, spread_close) > 1.185, false) AS extreme,
         coalesce(bar - lag(bar) OVER w = INTERVAL '15 minutes' AND abs(ln(mid_open / lag(mid_close) OVER w)) > 0.01, false) AS jump
  FROM flagged0 WINDOW w AS (ORDER BY bar))"""
)


def sql(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded as the oracles round, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, PLACES) + F.lit(0.0)
    return out.alias(name) if name else out


def q6(expr: str, name: str) -> str:
    return f"round({expr}, {PLACES}) + 0.0 AS {name}"


#: Products of some short decimals lie just between two rounded values, where engines differ in the last bit: they are
#: moved off the edge first, by less than a rounded place and by no short decimal.
NUDGE = 3.1415927e-8


def r6n(c: Column | str, name: str, places: int = PLACES) -> Column:
    return (F.round((F.col(c) if isinstance(c, str) else c) + NUDGE, places) + F.lit(0.0)).alias(name)


def q6n(expr: str, name: str, places: int = PLACES) -> str:
    return f"round({expr} + {NUDGE}::DOUBLE, {places}) + 0.0 AS {name}"
