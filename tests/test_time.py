"""Frames by time, ordered streams and day sketches against brute force."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import scan as SC
from tidemark.operators import sketches as K
from tidemark.plans.registry import ORACLES
from tidemark.streaming.ordered import drained, lagged_in_order


@pytest.mark.parametrize("span", [1, 40, 5000])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_covered_frames_over_parts(spark, span, by):
    rng = random.Random(span)
    rows = [(rng.choice("aab") if k % 9 else None, k, rng.choice([None, *[rng.randint(0, 900)] * 20]), rng.randint(0, 9)) for k in range(600)]
    gap = max(1, span // 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    short, SC.SHORT = SC.SHORT, 0
    try:
        df = spark.createDataFrame(rows, "g string, id long, t long, v long").repartition(3)
        got = SC.covered_frames(df, "t", span, gap, {"s": F.sum("v"), "m": F.max("id")}, ("id",), by).collect()
    finally:
        SC.SHORT = short
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows)
    for r in got:
        if r["t"] is None:
            assert r["n"] is r["widest"] is r["s"] is None
            continue
        frame = [x for x in rows if x[2] is not None and r["t"] - span <= x[2] < r["t"] and (not by or x[0] == r["g"])]
        marks = [r["t"] - span, *sorted(x[2] for x in frame), r["t"]]
        widest = max(b - a for a, b in zip(marks, marks[1:])) if frame else span
        whole = frame and widest <= gap
        assert (r["n"], r["widest"]) == (len(frame), widest), (r, marks)
        assert (r["s"], r["m"]) == ((sum(x[3] for x in frame), max(x[1] for x in frame)) if whole else (None, None))


def test_stream_orders_by_event_time_and_counts_late_rows(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rng = random.Random(6)
    rows = [(rng.randint(0, 3), k, start + datetime.timedelta(minutes=k), float(k)) for k in range(240)]
    files = [rows[:100], rows[60:180], rows[150:]]
    seen, batches = set(), []
    for f in files:  # overlapping files, each in no order
        fresh = [r for r in f if r[1] not in seen and rng.random() < 0.8 or f is files[-1] and r[1] not in seen]
        seen |= {r[1] for r in fresh}
        rng.shuffle(fresh)
        batches.append(fresh)
    missing = [r for r in rows if r[1] not in seen]
    late = missing[:3]
    assert len(late) == 3 and missing[:3][-1][2] < start + datetime.timedelta(minutes=100)
    batches.append([(9, 1, start + datetime.timedelta(days=2), 0.0)])
    batches.append(late + [(9, 2, start + datetime.timedelta(days=4), 0.0)])
    batches.append([(9, 3, start + datetime.timedelta(days=8), 0.0)])
    schema = "key long, id long, ts timestamp, value double"
    for f in batches:
        spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    found, dropped = drained(lagged_in_order(stream, "3 hours"))
    got = {r["id"]: (r["key"], r["lag_value"]) for r in found.where("key < 9").collect()}
    on_time = sorted((r for f in batches[:3] for r in f), key=lambda r: (r[2], r[1]))
    want, last = {}, {}
    for key, ident, _, value in on_time:
        want[ident] = (key, last.get(key))
        last[key] = value
    assert {k: (a, None if b != b else b) for k, (a, b) in got.items()} == want and dropped == 3


def test_periods_from_day_sketches(spark):
    rng = np.random.default_rng(8)
    n = 60_000
    rows = spark.createDataFrame([(int(d), "ab"[int(g)], float(v), int(u)) for d, g, v, u in zip(rng.integers(0, 20, n), rng.integers(0, 2, n), rng.lognormal(size=n), rng.integers(0, 9000, n))], "d int, g string, v double, u long")
    days = K.daily_sketches(rows, F.col("d"), ["g"], "v", "u")
    assert days.count() == 40
    exact = {r["g"]: r for r in rows.groupBy("g").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("v")).alias("v"), F.countDistinct("u").alias("u")).collect()}
    for r in K.merged(days, F.lit("all"), ["g"], (0.05, 0.5, 0.95)).collect():
        v = exact[r["g"]]["v"]
        assert (r["days"], r["n"], r["least"], r["greatest"]) == (20, len(v), v[0], v[-1])
        for p, q in zip((0.05, 0.5, 0.95), r["quantiles"]):
            assert abs(np.searchsorted(v, q) / len(v) - p) <= K.RANK_ERROR
        assert abs(r["distinct"] - exact[r["g"]]["u"]) <= K.DISTINCT_ERROR * exact[r["g"]]["u"]


def test_ordered_stream_from_many_files_and_buckets(spark, tmp_path, monkeypatch):
    import duckdb

    from tidemark.plans import streams as P

    start = datetime.datetime(2024, 1, 1)
    rng = random.Random(9)
    rows = [(k, start + datetime.timedelta(minutes=rng.randint(0, 30000) // 3 * 3), rng.choice([None, *range(40), *[7] * 30]), rng.choice([None, float(k)])) for k in range(900)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(P, "ROWS_A_FILE", 40)
    monkeypatch.setattr(P, "ROWS_A_BUCKET", 9)
    folder, files, n = P.shuffled_files(spark, str(tmp_path))
    assert (files, n) == (4, 900) and len(spark.read.parquet(folder).inputFiles()) == 4 * P.BATCHES + 1
    found = P.stream_lag_in_order(spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = c.execute(ORACLES["stream_lag_in_order"]).fetchall()
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
