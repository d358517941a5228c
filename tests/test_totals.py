"""Totals within spans against brute force, and that they make no row for each pair."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.operators import order_stats as OS
from tidemark.operators import scan as SC
from tidemark.operators import totals as TO

from .test_series import some_spans


@pytest.mark.parametrize("most", [7, 100_000])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_totals_of_points_within_spans(spark, monkeypatch, by, most):
    monkeypatch.setattr(TO.totals_within, "__defaults__", ((), most))
    rng = random.Random(most + len(by))
    spans = some_spans(rng, 60, 5000)
    points = [(k, rng.choice("ab") if k % 7 else None, rng.choice([None, *[rng.randint(-500, 500)] * 12]), rng.choice([None, -(2**54) + k, 5]), rng.choice([None, 1.5, float("nan"), -2.0])) for k in range(150)]
    s, p = spark.createDataFrame(spans, "id long, g string, s long, e long"), spark.createDataFrame(points, "id long, g string, t long, v long, x double")
    values = {"total": ("sum", F.col("v")), "least": ("min", F.col("v")), "most": ("max", F.col("x")), "low": ("min", F.col("x"))}
    got = sorted(map(str, J.interval_totals(s, p, ("s", "e"), "t", values, by).select("id", "g", "s", "e", "n", "total", "least", "most", "low").collect()))
    want = []
    for i, g, b, e in spans:
        within = [q for q in points if None not in (b, e, q[2]) and b <= q[2] < e and (not by or q[1] == g)]
        v, x = [q[3] for q in within if q[3] is not None], [q[4] for q in within if q[4] is not None]
        if within:
            order = sorted(x, key=lambda y: (y != y, y))
            want.append((i, g, b, e, len(within), sum(v) if v else None, min(v, default=None), order[-1] if x else None, order[0] if x else None))
    frame = spark.createDataFrame(want, "id long, g string, s long, e long, n long, total long, least long, most double, low double")
    assert got == sorted(map(str, frame.collect()))


@pytest.mark.parametrize("short", [0, 5000])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_totals_of_overlaps(spark, monkeypatch, by, short):
    monkeypatch.setattr(SC, "SHORT", short)
    rng = random.Random(short + len(by))
    a, b = some_spans(rng, 60, 5000), some_spans(rng, 90, 100_000)
    frames = [spark.createDataFrame(x, "id long, g string, s long, e long") for x in (a, b)]
    got = sorted(map(str, ((r["id"], r["s"], r["n"], int(r["common"])) for r in J.overlap_totals(*frames, ("s", "e"), ("s", "e"), by).collect())))
    want = []
    for i, g, s, e in a:
        both = [min(e, y[3]) - max(s, y[2]) for y in b if None not in (s, y[2]) and s < e and y[2] < y[3] and s < y[3] and y[2] < e and (not by or y[1] == g)]
        if both:
            want.append((i, s, len(both), sum(both)))
    assert got == sorted(map(str, want))


def test_totals_make_no_pairs(spark, monkeypatch):
    """Every span covers every point: 4 million pairs, of which no step may have a row."""
    n, seen = 2000, []
    rows = spark.range(n).select("id", F.col("id").alias("s"), (F.col("id") + n).alias("e"), (F.col("id") + n - 1).alias("t"))
    real = TO.temporary
    monkeypatch.setattr(TO, "temporary", lambda df, name: seen.append(real(df, name)) or seen[-1])
    found = J.interval_totals(rows, rows.select("t", "id"), ("s", "e"), "t", {"least": ("min", F.col("id"))})
    assert found.agg(F.sum("n")).head()[0] == n * (n + 1) // 2 and max(x.count() for x in seen) <= n
    plans = found._jdf.queryExecution().toString() + J.overlap_totals(rows, rows, ("s", "e"), ("s", "e"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plans and "_bin" not in plans and "_level" not in plans


@pytest.mark.parametrize("most", [9, 100_000])
@pytest.mark.parametrize("span", [1, 40, 5000])
def test_covered_totals_are_those_of_frames(spark, monkeypatch, span, most):
    monkeypatch.setattr(TO.totals_within, "__defaults__", ((), most))
    rng = random.Random(span)
    rows = [(rng.choice("aab") if k % 9 else None, k, rng.choice([None, *[rng.randint(0, 900)] * 20]), rng.choice([None, rng.randint(0, 9)])) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, id long, t long, v long").repartition(3)
    frames = SC.covered_frames(df, "t", span, max(1, span // 4), {"s": F.sum("v"), "m": F.max("id")}, ("id",), ("g",))
    pairs = SC.covered_frames(df, "t", span, max(1, span // 4), {"s": ("sum", F.col("v")), "m": ("max", F.col("id"))}, ("id",), ("g",))
    assert pairs.columns == frames.columns and sorted(map(str, pairs.collect())) == sorted(map(str, frames.collect()))
    assert "specifiedwindowframe(RangeFrame" not in pairs._jdf.queryExecution().toString()


def test_parts_that_python_holds_are_bounded(spark, monkeypatch):
    """A table of any size, and any series of it, is dealt by a number of rows."""
    monkeypatch.setattr(OS, "PART_ROWS", 50, raising=False)
    made, real = [], OS.lay_out
    monkeypatch.setattr(OS, "lay_out", lambda *a: made.append(real(*a)) or made[-1])
    rows = spark.range(1000).select("id", (F.col("id") % 2).alias("g"), F.rand(1).alias("v"))
    assert OS.rolling_order(rows, ["id"], F.col("v"), 30, ("g",)).count() == 1000
    firsts = [*[f for _, f in made[0].begins], made[0].n]
    assert max(b - a for a, b in zip(firsts, firsts[1:])) <= 150
