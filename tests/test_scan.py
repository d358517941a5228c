"""Ordered scans against the same windows over one partition."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import scan as SC


@pytest.fixture(scope="module")
def series(spark):
    kept, SC.SHORT = SC.SHORT, 0
    rng = random.Random(4)
    rows = [(rng.choice("aab") if k % 11 else None, k * 3 % 1009, rng.choice([None, float(rng.randint(-9, 9))])) for k in range(1009)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield spark.createDataFrame(rows, "g string, t long, v double").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    SC.SHORT = kept


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


@pytest.mark.parametrize("by", [(), ("g",)])
@pytest.mark.parametrize("strictly", [False, True])
def test_running_values(series, by, strictly):
    got = SC.running(series, ["t"], {k: (k, F.col("v")) for k in SC.KINDS}, by, strictly)
    frame = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, -1 if strictly else 0)
    last = F.last("v", ignorenulls=True).over(frame).alias("last")
    want = series.select("g", "t", "v", *[getattr(F, k)("v").over(frame).alias(k) for k in ("sum", "count", "min", "max")], last)
    assert len(SC.lay_out(series, ["t"], by).begins) > 8
    assert rows(got.select(want.columns).withColumn("count", F.coalesce("count", F.lit(0)))) == rows(want)


@pytest.mark.parametrize("by", [(), ("g",)])
def test_numbers(series, by):
    got = SC.numbered(series, [F.col("t").desc()], by, "n", "k" if by else None)
    want = series.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("t").desc())).cast("long"))
    if by:
        want = want.withColumn("k", F.dense_rank().over(Window.orderBy("g")).cast("long"))
    assert rows(got.select(want.columns)) == rows(want)


@pytest.mark.parametrize("by", [(), ("g",)])
@pytest.mark.parametrize("reach", [1, 40, 300, 3000])
def test_frames_reach_over_parts(series, by, reach):
    def columns(w):
        frame = w.rowsBetween(-reach, reach // 2)
        return {"s": F.sum("v").over(frame), "c": F.count("*").over(frame), "lag": F.lag("v", reach).over(w), "lead": F.lead("t", reach // 2).over(w)}

    got = SC.framed(series, ["t"], reach, reach // 2, columns, by)
    want = series.withColumns(columns(Window.partitionBy(*by).orderBy("t")))
    assert rows(got.select(want.columns)) == rows(want)


@pytest.mark.parametrize("block", [1, 10, 500, 2500])
def test_frames_that_wrap_around(series, block):
    got = SC.framed(series, ["t"], 2, block - 1, lambda w: {"s": F.sum("t").over(w.rowsBetween(0, block - 1)), "b": F.lag("t", 2).over(w)}, wrap=True)
    t = sorted(r["t"] for r in series.collect())
    for r in got.collect():
        at = t.index(r["t"])
        assert r["s"] == sum(t[(at + k) % len(t)] for k in range(block)) and r["b"] == t[at - 2]


@pytest.mark.parametrize("block", [1, 10, 2500])
def test_short_series_are_one_window(series, monkeypatch, block):
    columns = lambda w: {"s": F.sum("t").over(w.rowsBetween(-3, block - 1))}
    dealt = rows(SC.framed(series, ["t"], 3, block - 1, columns, wrap=True))
    sums = rows(SC.running(series, ["t"], {"s": ("sum", F.col("v"))}))
    monkeypatch.setattr(SC, "SHORT", 5000)
    assert rows(SC.framed(series, ["t"], 3, block - 1, columns, wrap=True)) == dealt
    assert rows(SC.running(series, ["t"], {"s": ("sum", F.col("v"))})) == sums


def test_empty_and_single(spark, series):
    none = series.limit(0)
    assert SC.running(none, ["t"], {"s": ("sum", F.col("v"))}).count() == 0
    assert SC.numbered(none, ["t"], ("g",)).count() == SC.framed(none, ["t"], 3, 3, lambda w: {"x": F.lag("v").over(w)}).count() == 0
    one = SC.framed(series.limit(1), ["t"], 3, 3, lambda w: {"x": F.count("*").over(w.rowsBetween(-3, 3))}, wrap=True).head()
    assert one["x"] == 7


def test_modules_still_travel_to_workers(series):
    """They go by value, with all they hold, after tables were made."""
    import sys

    from pyspark import cloudpickle

    SC.lay_out(series, ["t"])
    for name in ("tidemark.operators.simulate", "tidemark.sources.files", "tidemark.operators.scan"):
        __import__(name)
        assert cloudpickle.dumps(sys.modules[name])


def test_no_window_without_partition(series):
    plans = [SC.running(series, ["t"], {"s": ("sum", F.col("v"))}), SC.framed(series, ["t"], 5, 5, lambda w: {"x": F.lag("v", 5).over(w)}), SC.numbered(series, ["t"])]
    for df in plans:
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
