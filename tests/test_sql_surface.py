"""The replay in SQL text against the declarative one, on dense bars where trades are made."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import losses as L
from tidemark.functions import sql_surface as S
from tidemark.functions import stats as ST
from tidemark.operators import replay as RP


@pytest.fixture(scope="module")
def bars(spark):
    rng, price, rows = random.Random(12), 1000.0, []
    start = datetime.datetime(2024, 3, 1)
    for k in range(45 * 96):
        move = [rng.gauss(0, 0.25) for _ in range(4)]
        close, high, low = price + sum(move[:2]), price + abs(move[2]) + 0.4, price - abs(move[3]) - 0.4
        spread = rng.choice([0.2, 0.3])
        if rng.random() > 0.002:
            rows.append((start + datetime.timedelta(minutes=15 * k), price, max(high, close), min(low, close), close, price + spread, max(high, close) + spread, min(low, close) + spread, close + spread, rng.random() < 0.001))
        price = close + rng.choice([0, 0, 0, 0.6, -0.6])
    names = "bar timestamp_ntz, " + ", ".join(f"{f}_{s} double" for s in ("bid", "ask") for f in ("open", "high", "low", "close")) + ", suspect boolean"
    return spark.createDataFrame(rows, names)


@pytest.mark.parametrize("rules", [RP.Rules(), RP.Rules(cost=2.0, slip=0.2, exit_hours=6)])
def test_replay_as_a_table_function(spark, bars, rules):
    boxed = RP.boxes(bars, rules).withColumns({"valid": F.lit(True), "rel_width": F.lit(0.0)})
    want = {r["box_date"]: r for r in RP.replay(bars, boxed, rules).collect()}
    S.register(spark, rules)
    path = RP.paths(bars, boxed.select("box_date", "hi", "lo"), rules)
    got = spark.sql("SELECT * FROM breakout_replay(TABLE(SELECT * FROM {p}) PARTITION BY box_date ORDER BY bar)", p=path).collect()
    assert len(got) > 20 and {"stop", "time"} <= {r["status"] for r in got}
    for r in got:
        w = want[r["box_date"]]
        assert r["status"] == w["status"]
        for c in ("entry", "stop", "exit", "r"):
            assert r[c] == (None if w[c] is None else pytest.approx(w[c], abs=1e-9)), (c, r, w)


def test_functions_equal_the_column_expressions(spark):
    S.register(spark)
    df = spark.createDataFrame([(1.5, 2.0, 1.0), (0.3, 0.2, 0.4), (2.0, 0.0, 1.0), (None, 1.0, 1.0)], "a double, b double, c double")
    a, b, c = (F.col(x) for x in "abc")
    want = df.select(L.squared(a, b), L.absolute(a, b), L.qlike(a, b), L.improvement(a, b), L.clark_west(a, F.abs(b) + 0.1, c), ST.wilson(a, F.lit(9.0), 1.96, False), ST.wilson(a, F.lit(9.0), 1.96, True)).collect()
    text = "SELECT squared_loss(a, b), absolute_loss(a, b), qlike_loss(a, b), saved_share(a, b), clark_west_gain(a, abs(b) + 0.1D, c), wilson_low(a, 9D, 1.96D), wilson_high(a, 9D, 1.96D) FROM {d}"
    for x, y in zip(spark.sql(text, d=df).collect(), want):
        assert list(x) == [None if v is None else pytest.approx(v) for v in y]
