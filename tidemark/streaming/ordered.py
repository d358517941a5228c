"""Rows of a stream in event-time order, whatever the order they come in.

Keys are dealt to buckets by their hash. A bucket's state keeps the rows that may still be overtaken, packed, and the last
row that left of each of its keys. Each micro-batch that brings rows to a bucket, or whose watermark has passed the oldest
of them (a timeout), lets all rows up to the watermark leave in (time, id) order, each with its key's row before it. So
results do not depend on how rows lie in files and micro-batches, as long as no row is later than the watermark allows.
Rows that are later do not reach the state; the query's progress counts them.
"""

from __future__ import annotations

import contextlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..sources.files import staging

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LAGGED = "key long, id long, us long, value double, lag_us long, lag_value double"
#: Buckets of keys, and that of rows without a key.
BUCKETS, KEYLESS = 64, -1
_ROW = np.dtype([("key", "<i8"), ("us", "<i8"), ("id", "<i8"), ("value", "<f8")])


def _leave(waiting: np.ndarray, last: np.ndarray, passed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows before a time in order of key, time and id, with the place of each one's key's row before it (-1: none) in last
    and those rows together; the rows that stay; and the new last row of each key. last has one row a key."""
    due = waiting["us"] < passed
    go = waiting[due]
    both = np.concatenate([last, go])
    order = np.lexsort((both["id"], both["us"], np.arange(len(both)) >= len(last), both["key"]))
    same = both["key"][order[1:]] == both["key"][order[:-1]]
    before = np.full(len(both), -1)
    before[order[1:][same]] = order[:-1][same]
    ends = np.append(~same, True)[: len(both)]
    return go, before[len(last) :], waiting[~due], both[order[ends]]


def lagged_in_order(rows: DataFrame, late: str, buckets: int = BUCKETS) -> DataFrame:
    """LAGGED rows of a stream of (key, id, ts timestamp, value): times in microseconds, no two rows with equal time and id
    of one key. late: how far behind the latest row another may come."""
    import pandas as pd

    def step(bucket, frames, state):
        kept = state.getOption
        waiting, last = [np.frombuffer(bytes(x), _ROW) for x in kept] if kept else [np.empty(0, _ROW)] * 2
        fresh = [f[["key", "us", "id", "value"]].to_records(index=False).astype(_ROW) for f in frames] if not state.hasTimedOut else []
        waiting = np.concatenate([waiting, *fresh])
        go, before, waiting, last_now = _leave(waiting, last, state.getCurrentWatermarkMs() * 1000)
        state.update((waiting.tobytes(), last_now.tobytes()))
        if len(waiting):
            state.setTimeoutTimestamp(int(waiting["us"].min()) // 1000)
        if len(go):
            both = np.concatenate([last, go])[before]
            out = {c: go[c] for c in ("key", "id", "us", "value")}
            if bucket[0] == KEYLESS:
                out["key"] = pd.array([None] * len(go), "Int64")
            out["lag_us"] = pd.arrays.IntegerArray(both["us"].copy(), before < 0)
            out["lag_value"] = np.where(before < 0, np.nan, both["value"])
            yield pd.DataFrame(out)

    bucket = F.when(F.col("key").isNull(), KEYLESS).otherwise(F.pmod(F.xxhash64("key"), F.lit(buckets))).cast("int").alias("bucket")
    marked = rows.withWatermark("ts", late).select(bucket, F.coalesce("key", F.lit(0)).alias("key"), "id", F.unix_micros("ts").alias("us"), F.coalesce("value", F.lit(float("nan"))).alias("value"), "ts")
    return marked.groupBy("bucket").applyInPandasWithState(step, LAGGED, "waiting binary, last binary", "append", GroupStateTimeout.EventTimeTimeout)


@contextlib.contextmanager
def rocks(spark: SparkSession):
    """State on disk, not in the executors' memory."""
    old = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, old)


def drained(stream: DataFrame, name: str = "ordered") -> tuple[DataFrame, int]:
    """Process what is there, then stop: the rows of an append-only stream, and how many came too late."""
    spark = stream.sparkSession
    out, marks = staging(spark, name), staging(spark, f"{name}-marks")
    with rocks(spark):
        q = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        q.awaitTermination()
    late = sum(s.numRowsDroppedByWatermark for p in q.recentProgress for s in p.stateOperators)
    return spark.read.schema(stream.schema).parquet(out), late
