"""Order, limits, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as J
from ..sources.market import bars, daily, second_feed, table, trades
from .registry import query
from .views import BARS, DAILY, FEED_B, TRADES, q6, r6, sql

_PAIR = BARS + ", " + FEED_B


@query("sort", sql(TRADES, f"SELECT book, n, {q6('r', 'r')} FROM trades ORDER BY r DESC, book, n"))
def sort(spark, sf):
    return trades(spark, sf).orderBy(F.desc("r"), "book", "n").select("book", "n", r6("r", "r"))


@query("topk_200", sql(BARS, f"SELECT bar, {q6('abs(close_bid - open_bid)', 'move')} FROM bars ORDER BY abs(close_bid - open_bid) DESC, bar LIMIT 200"))
def topk_200(spark, sf):
    move = F.abs(F.col("close_bid") - F.col("open_bid"))
    return bars(spark, sf).select("bar", move.alias("m")).orderBy(F.desc("m"), "bar").limit(200).select("bar", r6("m", "move"))


@query("limit_50", sql(BARS, "SELECT bar, quote_count FROM bars WHERE quote_count < 3 ORDER BY bar LIMIT 50"))
def limit_50(spark, sf):
    return bars(spark, sf).where("quote_count < 3").select("bar", "quote_count").orderBy("bar").limit(50)


@query("trim_best", sql(TRADES, f"SELECT book, f::DOUBLE AS fraction, count(*) AS n, {q6('sum(r)', 'total_r')} FROM (SELECT book, r, row_number() OVER (PARTITION BY book ORDER BY r DESC, n) AS k, count(*) OVER (PARTITION BY book) AS m FROM trades), (VALUES (0.01), (0.05), (0.1)) x(f) WHERE k > ceil(m * f::DOUBLE) GROUP BY 1, 2"))
def trim_best(spark, sf):
    book = Window.partitionBy("book")
    k = trades(spark, sf).select("book", "r", F.row_number().over(book.orderBy(F.desc("r"), "n")).alias("k"), F.count("*").over(book).alias("m"))
    kept = F.array_compact(F.array(*[F.when(F.col("k") > F.ceil(F.col("m") * F.lit(f)), F.lit(f)) for f in (0.01, 0.05, 0.1)]))
    return k.select("book", "r", F.explode(kept).alias("fraction")).groupBy("book", "fraction").agg(F.count("*").alias("n"), r6(F.sum("r"), "total_r"))


@query("stratified_sample", "SELECT year, priority, o_orderkey FROM (SELECT year(o_orderdate)::INTEGER AS year, o_orderpriority AS priority, o_orderkey, row_number() OVER (PARTITION BY year(o_orderdate), o_orderpriority ORDER BY md5('11:' || o_orderkey::VARCHAR)) AS k FROM orders) WHERE k = 1")
def stratified_sample(spark, sf):
    # The least hash of a stratum is an aggregate: no stratum is sorted.
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("priority"), "o_orderkey")
    return o.groupBy("year", "priority").agg(F.min_by("o_orderkey", F.md5(F.concat(F.lit("11:"), F.col("o_orderkey").cast("string")))).alias("o_orderkey"))


@query("union_all", sql(_PAIR, f"SELECT bar, 'a' AS feed, {q6('close_bid', 'close_bid')} FROM bars UNION ALL SELECT bar, 'b', {q6('close_bid', 'close_bid')} FROM feed_b"))
def union_all(spark, sf):
    b = bars(spark, sf)
    pick = lambda d, n: d.select("bar", F.lit(n).alias("feed"), r6("close_bid", "close_bid"))
    return pick(b, "a").unionByName(pick(second_feed(b), "b"))


def _keys(spark, sf):
    b = bars(spark, sf)
    return b.where(F.hour("bar") < 18).select("bar"), second_feed(b).where(F.hour("bar") >= 6).select("bar")


_KEYS = _PAIR + ", a AS (SELECT bar FROM bars WHERE hour(bar) < 18), b AS (SELECT bar FROM feed_b WHERE hour(bar) >= 6)"


@query("intersect_keys", sql(_KEYS, "SELECT bar FROM a INTERSECT SELECT bar FROM b"))
def intersect_keys(spark, sf):
    a, b = _keys(spark, sf)
    return a.intersect(b)


@query("except_keys", sql(_KEYS, "SELECT bar FROM a EXCEPT SELECT bar FROM b"))
def except_keys(spark, sf):
    a, b = _keys(spark, sf)
    return a.exceptAll(b)


@query("union_distinct", sql(_KEYS, "SELECT bar FROM a UNION SELECT bar FROM b"))
def union_distinct(spark, sf):
    a, b = _keys(spark, sf)
    return a.union(b).distinct()


@query("set_equality", sql(_KEYS, "SELECT 'same' AS pair, (SELECT count(*) FROM (SELECT bar FROM a EXCEPT SELECT bar FROM a)) = 0 AS equal UNION ALL SELECT 'other', (SELECT count(*) FROM (SELECT bar FROM a EXCEPT SELECT bar FROM b)) + (SELECT count(*) FROM (SELECT bar FROM b EXCEPT SELECT bar FROM a)) = 0"))
def set_equality(spark, sf):
    a, b = _keys(spark, sf)
    one = lambda x, y, n: J.symmetric_difference(x, y).agg((F.count("*") == 0).alias("equal")).select(F.lit(n).alias("pair"), "equal")
    return one(a, a, "same").unionByName(one(a, b, "other"))


@query("dict_value_change", sql(DAILY, f"SELECT x.date, {q6('x.a', 'before')}, {q6('y.a', 'after')} FROM daily x JOIN (SELECT date, CASE WHEN day(date) = 15 THEN a + 1 WHEN day(date) = 16 THEN NULL ELSE a END AS a FROM daily) y USING (date) WHERE x.a IS DISTINCT FROM y.a"))
def dict_value_change(spark, sf):
    d = daily(spark, sf).select("date", "a")
    day = F.dayofmonth("date")
    new = d.select("date", F.when(day == 15, F.col("a") + 1).when(day == 16, F.lit(None)).otherwise(F.col("a")).alias("b"))
    return d.join(new, "date").where(~F.col("a").eqNullSafe(F.col("b"))).select("date", r6("a", "before"), r6("b", "after"))
