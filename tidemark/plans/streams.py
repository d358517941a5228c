"""Streaming twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.files import staging
from ..sources.market import table
from ..streaming.bars import bars_stream, collected_available, events_stream, lag_stream, quotes_stream, run_available
from ..streaming.ordered import BUCKETS, drained, lagged_in_order
from .registry import query
from .views import BARS, q6, r6, sql


@query("stream_bars", sql(BARS, f"SELECT bar, {q6('open_bid', 'open_bid')}, {q6('high_bid', 'high_bid')}, {q6('low_bid', 'low_bid')}, {q6('close_bid', 'close_bid')}, quote_count FROM bars"))
def stream_bars(spark, sf):
    found = run_available(bars_stream(quotes_stream(spark, sf), 15), "bar")
    return found.select("bar", *[r6(c, c) for c in ("open_bid", "high_bid", "low_bid", "close_bid")], "quote_count")


@query("stream_causal_lag", f"SELECT event_id, {q6('CASE WHEN epoch(ts) - epoch(p) <= 24 * 3600 THEN v END', 'lag_value')} FROM (SELECT event_id, ts, lag(ts) OVER w AS p, lag(value) OVER w AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def stream_causal_lag(spark, sf):
    return collected_available(lag_stream(events_stream(spark, sf))).select("event_id", r6(F.nanvl(F.col("lag_value"), F.lit(None).cast("double")), "lag_value"))


#: Batches the events are dealt to, hours a row may lie in a later batch than its time says, and closing key;
#: rows a file and a bucket of state.
BATCHES, JITTER, CLOSING = 6, 30, -1
ROWS_A_FILE, ROWS_A_BUCKET = 250_000, 50_000


def shuffled_files(spark, sf) -> tuple[str, int, int]:
    """All events in batches that overlap in time: a row comes up to JITTER hours late, in no order within its batch. Each
    batch is the same number of files, which is returned with the folder and the number of events. The last one is a file
    with one row far ahead, of a key of its own, after which nothing can come."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    first, last, n = e.agg(F.min("ts"), F.max("ts"), F.count("*")).head()
    files = 1 + n // (BATCHES * ROWS_A_FILE)
    late = F.pmod(F.xxhash64("id"), F.lit(JITTER * 3600))
    place = (F.unix_seconds("ts") + late - F.unix_seconds(F.lit(first))) / (F.unix_seconds(F.lit(last)) - F.unix_seconds(F.lit(first)) + JITTER * 3600 + 1)
    folder = staging(spark, "late-rows")
    dealt = e.withColumn("_batch", F.floor(place * BATCHES).cast("int"))
    for k in range(BATCHES):  # one after the other: a stream reads files by age
        dealt.where(F.col("_batch") == k).drop("_batch").repartition(files).sortWithinPartitions(F.xxhash64("id", F.lit(1))).write.mode("append").parquet(folder)
    close = e.agg((F.max("ts") + F.expr(f"INTERVAL {10 * JITTER} HOURS")).alias("ts")).select(F.lit(CLOSING).cast("long").alias("key"), F.lit(0).cast("long").alias("id"), "ts", F.lit(0.0).alias("value"))
    close.write.mode("append").parquet(folder)
    return folder, files, n


@query("stream_lag_in_order", """SELECT event_id, epoch_us(lag(ts) OVER w) AS lag_us, lag(value) OVER w AS lag_value, 0::BIGINT AS late FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def stream_lag_in_order(spark, sf):
    """Each event with its user's event before it, from a stream that brings them out of order over several batches."""
    folder, files, n = shuffled_files(spark, sf)
    rows = spark.readStream.schema("key long, id long, ts timestamp, value double").option("maxFilesPerTrigger", files).parquet(folder)
    found, late = drained(lagged_in_order(rows, f"{JITTER + 1} hours", max(BUCKETS, n // ROWS_A_BUCKET)))
    return found.where(~F.col("key").eqNullSafe(CLOSING)).select(F.col("id").alias("event_id"), "lag_us", F.nanvl(F.col("lag_value"), F.lit(None).cast("double")).alias("lag_value"), F.lit(late).cast("long").alias("late"))
