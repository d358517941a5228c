"""The bar builder on a stream: the same bars as the batch, from micro-batches with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import staging

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def quotes_stream(spark: SparkSession, sf_dir: str, files_a_batch: int = 1) -> DataFrame:
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files_a_batch).parquet(sf_dir)
    bid = F.lit(1000.0) + F.col("value") * 0.05
    ask = bid + 0.2 + F.get_json_object("props", "$.k").cast("double") / 100.0
    return rows.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", bid.alias("bid"), ask.alias("ask"))


def bars_stream(quotes: DataFrame, minutes: int, late: str = "1 hour") -> DataFrame:
    """Bars as they stand after each micro-batch; state older than the watermark is dropped."""
    order = F.struct("ts", "event_id")
    g = quotes.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"))
    return g.agg(F.min_by("bid", order).alias("open_bid"), F.max("bid").alias("high_bid"), F.min("bid").alias("low_bid"), F.max_by("bid", order).alias("close_bid"), F.count("*").alias("quote_count")).select(F.col("window.start").cast("timestamp_ntz").alias("bar"), "open_bid", "high_bid", "low_bid", "close_bid", "quote_count")


def run_available(stream: DataFrame, key: str) -> DataFrame:
    """Process what is there, then stop; each micro-batch appends its updates, and the latest of a key counts."""
    spark = stream.sparkSession
    out, marks = staging(spark, "stream"), staging(spark, "stream-marks")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("append").parquet(out)

    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out)
    cols = [c for c in rows.columns if c not in (key, "_epoch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), "_epoch").alias("_last")).select(key, "_last.*")


LAGGED = "user_id long, event_id long, ts timestamp, value double, lag_value double"


def lag_stream(events: DataFrame, most_hours: int = 24) -> DataFrame:
    """Each event with its user's latest value before it, null if that is older than most_hours: one value of state a user.

    Events reach a user's state in micro-batches; inside one they are put in (ts, event_id) order.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        last_ts, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for r in rows.itertuples():
            fresh = last_ts is not None and (r.ts.timestamp() - last_ts) <= most_hours * 3600
            out.append((key[0], r.event_id, r.ts, r.value, last if fresh else None))
            last_ts, last = float(r.ts.timestamp()), float(r.value)
        state.update((last_ts, last))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "ts", "value", "lag_value"])

    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return rows.groupBy("user_id").applyInPandasWithState(step, LAGGED, "last_ts double, last double", "append", GroupStateTimeout.NoTimeout)


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def collected_available(stream: DataFrame) -> DataFrame:
    """Process what is there, then stop; the rows of an append-only stream as a table."""
    spark = stream.sparkSession
    out, marks = staging(spark, "stream"), staging(spark, "stream-marks")
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
