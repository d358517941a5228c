"""Deterministic market-style views over the test tables: quotes, bars, a second feed, a daily ledger, trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import temporary

BASE_MINUTES = 15
SIDES = ("bid", "ask")
FIELDS = ("open", "high", "low", "close")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, event_id, bid, ask) of every event."""
    k = F.get_json_object("props", "$.k").cast("double")
    bid = F.lit(1000.0) + F.col("value") * 0.05
    return table(spark, sf_dir, "events").select("ts", "event_id", bid.alias("bid"), (bid + 0.2 + k / 100.0).alias("ask"))


def ohlc(ticks: DataFrame, minutes: int = BASE_MINUTES) -> DataFrame:
    """Bid and ask OHLC of each base bar, in (ts, event_id) order: one partial aggregate, one shuffle."""
    order = F.struct("ts", "event_id")
    aggs = []
    for s in SIDES:
        aggs += [F.min_by(s, order).alias(f"open_{s}"), F.max(s).alias(f"high_{s}"), F.min(s).alias(f"low_{s}"), F.max_by(s, order).alias(f"close_{s}")]
    return ticks.groupBy(F.window("ts", f"{minutes} minutes")["start"].alias("bar")).agg(*aggs, F.count("*").alias("quote_count"))


def bars(spark: SparkSession, sf_dir: str, minutes: int = BASE_MINUTES) -> DataFrame:
    return ohlc(quotes(spark, sf_dir), minutes)


def second_feed(base: DataFrame) -> DataFrame:
    """The bars without every seventh 15-minute slot, the bid side 0.0005 higher."""
    slot = (F.unix_timestamp(F.col("bar").cast("timestamp")) / (BASE_MINUTES * 60)).cast("long")
    shifted = {f"{f}_bid": F.col(f"{f}_bid") + 0.0005 for f in FIELDS}
    return base.where(F.pmod(slot, F.lit(7)) != 0).withColumns(shifted)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, a, l, r, d) on weekdays: sums of squared log price deviations by order priority; d is null if one is.

    Stored, a row a day: sums of doubles take their last bits from the order in which a shuffle's blocks come in, so a
    plan that sums twice may rank, join or compare two different values of one day."""
    v = F.pow(F.log("o_totalprice") - 11, 2)
    p = F.substring("o_orderpriority", 1, 1)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"), v.alias("v"), p.alias("p")).where(F.weekday("date") < 5)
    out = rows.groupBy("date").agg(F.sum(F.when(F.col("p").isin("1", "2"), F.col("v"))).alias("a"), F.sum(F.when(F.col("p") == "3", F.col("v"))).alias("l"), F.sum(F.when(~F.col("p").isin("1", "2", "3"), F.col("v"))).alias("r"))
    return temporary(out.withColumn("d", F.col("a") + F.col("l") + F.col("r")), "daily")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, n, exit_date, r, risk, direction, minutes) of all line items: a supplier's are a book, numbered in order."""
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("book"),
        F.row_number().over(order).cast("long").alias("n"),
        F.col("l_shipdate").cast("date").alias("exit_date"),
        ((F.col("l_partkey") % 41 - 19) / 10.0).alias("r"),
        (1 + F.col("l_quantity") / 10.0).alias("risk"),
        F.when(F.col("l_returnflag") == "R", "short").otherwise("long").alias("direction"),
        (15 * F.col("l_quantity")).alias("minutes"),
    )
