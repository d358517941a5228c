"""Queries written as SQL text, on the functions that the library registers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql_surface as S
from ..operators import replay as RP
from .events_and_risk import _REPLAY, THIN, _boxed
from .registry import query
from .statistics import _FIT, _LOSS, frozen
from .views import q6, sql


@query("sql_replay", sql(_REPLAY, f"""SELECT box_date, status, {q6('CASE WHEN complete AND risk > 0 THEN entry END', 'entry')}, {q6('CASE WHEN complete AND risk > 0 THEN stop END', 'stop')},
  {q6('CASE WHEN complete AND risk > 0 THEN exit END', 'exit')}, {q6('CASE WHEN complete AND risk > 0 THEN r END', 'r')} FROM stated"""))
def sql_replay(spark, sf):
    """The replay of every box by a table function over partitions of bars."""
    S.register(spark, THIN)
    bars, boxed = _boxed(spark, sf)
    path = RP.paths(bars, boxed.select("box_date", "hi", "lo"), THIN)
    path = path.select("box_date", "bar", "since", "suspect", "open_bid", "open_ask", "high_bid", "low_bid", "high_ask", "hi", "lo")
    return spark.sql(
        """SELECT b.box_date, coalesce(r.status, 'incomplete_execution_path') AS status, round(r.entry, 6) + 0.0D AS entry, round(r.stop, 6) + 0.0D AS stop, round(r.exit, 6) + 0.0D AS exit, round(r.r, 6) + 0.0D AS r
        FROM {boxes} b LEFT JOIN (SELECT * FROM breakout_replay(TABLE(SELECT * FROM {path}) PARTITION BY box_date ORDER BY bar)) r ON b.box_date = r.box_date""",
        boxes=boxed.select("box_date"), path=path,
    )


_CW = "avg(power(ln(l) - ln(lag_l), 2) - power(ln(l) - ln(forecast), 2) + power(ln(lag_l) - ln(forecast), 2))"


@query("sql_losses", sql(_FIT, f"SELECT year(date)::INTEGER AS year, count(*) AS n, {', '.join(q6(f'avg({e})', k) for k, (e, _) in _LOSS.items())}, {q6('(avg({1}) - avg({0})) / avg({1})'.format(*_LOSS['qlike']), 'saved')}, {q6(_CW, 'clark_west')} FROM fc GROUP BY 1"))
def sql_losses(spark, sf):
    """Losses of a forecast by year, in SQL on the registered functions."""
    S.register(spark)
    return spark.sql(
        """SELECT year, n, round(mse, 6) + 0.0D AS mse, round(mae, 6) + 0.0D AS mae, round(qlike, 6) + 0.0D AS qlike, round(saved, 6) + 0.0D AS saved, round(clark_west, 6) + 0.0D AS clark_west FROM (
          SELECT *, saved_share(plain, qlike) AS saved FROM (
            SELECT year(date) AS year, count(*) AS n, avg(squared_loss(l, forecast)) AS mse, avg(absolute_loss(l, forecast)) AS mae, avg(qlike_loss(l, forecast)) AS qlike,
              avg(qlike_loss(l, lag_l)) AS plain, avg(clark_west_gain(l, lag_l, forecast)) AS clark_west FROM {f} GROUP BY 1))""",
        f=frozen(spark, sf),
    )


@query("sql_wilson", f"""SELECT event_type, count(*) AS n, {q6('min((k/n + 3.8414588206941254/(2*n) - 1.959963984540054*sqrt(k/n*(1-k/n)/n + 3.8414588206941254/(4*n*n))) / (1 + 3.8414588206941254/n))', 'low')},
  {q6('min((k/n + 3.8414588206941254/(2*n) + 1.959963984540054*sqrt(k/n*(1-k/n)/n + 3.8414588206941254/(4*n*n))) / (1 + 3.8414588206941254/n))', 'high')}
FROM (SELECT event_type, count(*) FILTER (value > 50) OVER w::DOUBLE AS k, count(*) OVER w::DOUBLE AS n FROM events WINDOW w AS (PARTITION BY event_type)) GROUP BY 1""".replace("OVER w::DOUBLE", "OVER w"))
def sql_wilson(spark, sf):
    """Intervals of the share of events over 50, by type."""
    S.register(spark)
    counts = spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("k"), F.count("*").alias("n"))
    return spark.sql("SELECT event_type, n, round(wilson_low(k, n, 1.959963984540054D), 6) + 0.0D AS low, round(wilson_high(k, n, 1.959963984540054D), 6) + 0.0D AS high FROM {c}", c=counts)
