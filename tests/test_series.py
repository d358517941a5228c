"""Interval joins, circular shifts, rolling order statistics and walks against brute force on small odd inputs."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.operators import nested as N
from tidemark.operators import order_stats as OS
from tidemark.operators import scan as SC
from tidemark.operators import shifts as SH
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


def some_spans(rng, n, most):
    out = []
    for k in range(n):
        begin = rng.choice([None, *[rng.randint(-500, 500)] * 12])
        length = rng.choice([0, -3, 1, 2, 3, 5, 60, 900, most])
        out.append((k, rng.choice("ab") if k % 7 else None, begin, None if begin is None else begin + length))
    return out + out[:5]


@pytest.mark.parametrize("hot", [3, 10_000])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_interval_join_of_any_lengths(spark, by, hot):
    rng = random.Random(len(by) + hot)
    a, b = some_spans(rng, 80, 5000), some_spans(rng, 120, 100_000)
    frames = [spark.createDataFrame(x, "id long, g string, s long, e long") for x in (a, b)]
    meet = lambda x, y: None not in (x[2], y[2]) and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3] and (not by or x[1] == y[1])
    want = sorted((x[0], y[0]) for x in a for y in b if meet(x, y))
    found = J.interval_join(*frames, ("s", "e"), ("s", "e"), by, hot)
    assert sorted((r["left"]["id"], r["right"]["id"]) for r in found.collect()) == want
    points = sorted((x[0], y[0]) for x in a for y in b if meet((*x[:3], None if x[2] is None else x[2] + 1), y))
    found = J.interval_join(*frames, ("s", None), ("s", "e"), by, hot)
    assert sorted((r["left"]["id"], r["right"]["id"]) for r in found.collect()) == points
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_interval_join_of_nothing(spark):
    none = spark.createDataFrame([], "id long, s timestamp_ntz, e timestamp_ntz")
    assert J.interval_join(none, none, ("s", "e"), ("s", None)).count() == 0


def ranks(x):
    return np.array([2 * (x < v).sum() + (x == v).sum() + 1 for v in x]) - len(x) - 1


@pytest.mark.parametrize("n", [1, 2, 3, 31, 100])
def test_all_shifts_equal_direct_sums(spark, n):
    rng = np.random.default_rng(n)
    series = {"a": (rng.integers(0, 5, n), rng.integers(0, 9, n)), None: (np.zeros(n, int), rng.integers(0, 9, n)), "long": (rng.integers(0, 50, 3 * n), rng.integers(0, 50, 3 * n))}
    rows = [(s, t, int(u), int(v)) for s, (x, y) in series.items() for t, (u, v) in enumerate(zip(x, y))]
    got = {r["series"]: r for r in SH.shift_test(spark.createDataFrame(rows, "series string, at long, x long, y long"), "series", ["at"], "x", "y").collect()}
    assert got.keys() == series.keys()
    for s, (x, y) in series.items():
        u, v = ranks(x), ranks(y)
        c = np.array([(u * np.roll(v, -k)).sum() for k in range(len(u))])
        reached = int((abs(c[1:]) >= abs(c[0])).sum())
        scale = np.sqrt(float((u * u).sum()) * (v * v).sum())
        r = got[s]
        assert (r["n"], r["reached"], r["p"]) == (len(u), reached, pytest.approx((1 + reached) / len(u)))
        assert r["rho"] is None if scale == 0 else r["rho"] == pytest.approx(c[0] / scale)


def test_products_of_every_shift(spark):
    n = 45
    x, y = np.arange(n) % 7 - 3, np.arange(n) * 5 % 11 - 4
    rows = spark.createDataFrame([("s", t, n, int(a), int(b)) for t, (a, b) in enumerate(zip(x, y))], "series string, t long, n long, x long, y long")
    got = {r["shift"]: r["product"] for r in SH.circular_products(rows, n).collect()}
    assert got == {k: pytest.approx(float((x * np.roll(y, -k)).sum()), abs=1e-6) for k in range(n)}


@pytest.mark.parametrize("length", [1, 7, 5000])
def test_rolling_order_statistics(spark, length):
    rng = random.Random(length)
    rows = [(rng.choice("aab") if k % 9 else None, k, rng.choice([None, float("nan"), *[float(rng.randint(0, 30))] * 9])) for k in range(700)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        df = spark.createDataFrame(rows, "g string, t long, v double").repartition(4)
        got = OS.rolling_order(df, ["t"], F.col("v"), length, ("g",), (0.0, 0.25, 1.0)).collect()
        assert len(SC.lay_out(df, ["t"], ("g",)).begins) > 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    known = lambda v: v is not None and v == v
    assert len(got) == len(rows)
    for r in got:
        frame = [v for g, t, v in rows if g == r["g"] and t < r["t"]][-length:]
        frame = [v for v in frame if known(v)]
        v = r["v"]
        below, ties = (sum(x < v for x in frame), sum(x == v for x in frame)) if known(v) else (0, 0)
        assert (r["n_known"], r["n_below"], r["n_equal"]) == (len(frame), below, ties)
        assert r["quantiles"] == (pytest.approx(np.quantile(frame, (0.0, 0.25, 1.0))) if frame else None)


DOCS = ['{"a": {"b": [1, {"c": "x"}, []], "d": null}, "e": true, "f": {}}', "[[[1.5]]]", "3", '"s"', "null", None, "no json", '{"instrument": {"instrument": "XAU"}}', json.dumps({"k": [0] * 1 + [{"deep": {"deep": [None, "y"]}}]})]


def walked(v, path="$", name=None, depth=0):
    kind = "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "null" if v is None else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number"
    text = None if kind in ("object", "array", "null") else json.dumps(v) if kind != "string" else v
    yield path, name, depth, kind, text
    for step, k, x in [(f".{k}", k, x) for k, x in v.items()] if kind == "object" else [(f"[{i}]", None, x) for i, x in enumerate(v)] if kind == "array" else []:
        yield from walked(x, path + step, k, depth + 1)


def test_walk_of_any_shape(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "id long, doc string")
    want = [(i, *w) for i, d in enumerate(DOCS) if d not in (None, "no json") for w in walked(json.loads(d))]
    got = N.walk(df, "id", "doc")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert [(r["path"], r["value"]) for r in N.found(df, "id", "doc", "instrument", "XAU").collect()] == [("$.instrument.instrument", "XAU")]
    assert N.walk(df.limit(0), "id", "doc").count() == 0


@pytest.mark.parametrize("name", ["events_running", "events_block_sums", "events_autocov", "events_hac", "events_cum_qlike", "rolling_order_all", "join_interval_points"])
def test_no_task_of_the_plan_holds_the_series(spark, monkeypatch, name):
    monkeypatch.setattr(SC, "SHORT", 0)
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window " in x]
    assert all("_part" in x for x in windows) and "NestedLoop" not in plan, windows


ODD = ['{"a": 1e3, "b": [-0, 1.50, 12345678901234567890123]}', '"\\ud83d\\ude00 \\ud800"', '{"a": 1, "a": 2}', "NaN", " [1, 2] 3", '{"x[0]": {"y.z": [true, null, {"": "é\\n"}]}}', "[" * 9 + "]" * 9, '{"v": "1.5"}', "", '{"n": 123456789012345678, "m": -7}']


def test_walk_in_one_go_equals_the_walk_by_levels(spark, monkeypatch):
    monkeypatch.setattr(N, "BATCH", 3, raising=False)
    df = spark.createDataFrame(list(enumerate((DOCS + ODD) * 2)), "id long, doc string")
    levels = N.walk_levels(df, "id", "doc").localCheckpoint()
    assert sorted(map(str, N.walk(df, "id", "doc").collect())) == sorted(map(str, levels.collect()))
    shape = F.regexp_replace("path", r"\[[0-9]+\]", "[*]").alias("shape")
    want = levels.groupBy(shape, "kind").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"), F.max("depth").alias("depth"))
    assert sorted(map(str, N.shapes(df, "id", "doc").collect())) == sorted(map(str, want.collect()))


def test_plain_documents_take_one_step(spark, monkeypatch):
    stored, real = [], N.temporary
    monkeypatch.setattr(N, "temporary", lambda df, name: stored.append(name) or real(df, name))
    deep = '{"a": ' * 9 + "1" + "}" * 9
    assert N.walk(spark.createDataFrame([(1, deep)], "id long, doc string"), "id", "doc").count() == 10
    assert stored == ["documents"]


def test_shapes_travel_as_packed_texts(spark, monkeypatch):
    monkeypatch.setattr(N, "GATHERED", 500)
    docs = [json.dumps({"n": i, "s": f"s{i % 90}", "x": {f"k[{i}]": i % 3 == 0}, "l": [i % 7, str(i % 7), [], None]}) for i in range(600)] + ['{"n": 5, "s": 1.5}', '{"n": 5.0}', '{"n": 5, "s": "\\ud800"}'] + ODD
    df = spark.createDataFrame(list(enumerate(docs)), "id long, doc string").repartition(3)
    levels = N.walk_levels(df, "id", "doc").localCheckpoint()
    shape = F.regexp_replace("path", r"\[[0-9]+\]", "[*]").alias("shape")
    want = levels.groupBy(shape, "kind").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"), F.max("depth").alias("depth"))
    got = N.shapes(df, "id", "doc")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange ") == 2 and "texts" in plan  # packed texts, then one row a shape and task


def test_documents_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(N, "DEALT", 50)
    df = spark.createDataFrame([(i, '{"key": %d}' % i) for i in range(400)], "id long, doc string").coalesce(1)
    stored, real = [], N.temporary
    monkeypatch.setattr(N, "temporary", lambda df, name: stored.append(real(df, name)) or stored[-1])
    found = N.found(df, "id", "doc", "key", "7$")
    assert sorted(r["value"] for r in found.collect()) == sorted(str(i) for i in range(7, 400, 10))
    assert len(stored[0].inputFiles()) == 8 and spark.conf.get(N._ROWS_A_FILE) == "0"


def test_only_wanted_values_leave_the_walk(spark):
    df = spark.createDataFrame([(i, '{"key": %d, "x": {"key": "%d"}}' % (i, i + 1)) for i in range(400)], "id long, doc string")
    got = N._find(df, "id", "key", N._ends("7$"))
    assert sorted((r["path"], r["value"]) for r in got.collect()) == sorted([("$.key", str(i)) for i in range(7, 400, 10)] + [("$.x.key", str(i)) for i in range(7, 400, 10)])
    assert N._ends("7$")[0] == "7" and N._ends(".7$") == N._ends("7") == ("",)


FORMS = [
    ['{"key": 1, "l": [{"key": "a7", "in": [[{"key": -17}], [], [{"key": 27}, {}]]}, {}], "no": null, "e": {}, "key.s": {"key": true}}', '{"l": [], "key": 7}', "{}", '{"l": [{"in": null}, {"key": "7\\n"}], "key": null}', ' {"key.s": {"key": false}, "key": -0} '],
    ['{"key": 7}', '{"key": "7"}'],
    ['{"key": 7}', '{"other": 7}'] * 40,
    ['{"t": "2020-01-01", "key": "2020-01-07"}', '{"key": "2020-01-17T00:00:07", "t": "x"}'],
    ['{"key":\n7}', '{"key": 17} {"key": 27}', '{"key": 7} 7', "7", '[{"key": 7}]'],
    ['{"key": 7}'] * 60 + ['{"key": 123456789012345677, "new": [7, {"key": "07"}]}', '{"key": [{"key": 7}]}', '{"key": {"key": 7}}'],
    [json.dumps({f"k{i}": {"key": i}}) for i in range(300)],
]


@pytest.mark.parametrize("docs, pattern", [(x, "7$") for x in FORMS] + [(FORMS[0], "e$"), (DOCS + ODD + sum(FORMS, []), "[17]")])
def test_found_equals_the_walk_by_levels(spark, docs, pattern, monkeypatch):
    monkeypatch.setattr(N, "BATCH", 3)
    df = spark.createDataFrame(list(enumerate(docs)), "id long, doc string").coalesce(1)
    levels = N.walk_levels(df, "id", "doc").where(F.col("name") == "key").where(F.col("value").rlike(pattern))
    assert sorted(map(str, N.found(df, "id", "doc", "key", pattern).collect())) == sorted(map(str, levels.collect()))


def test_documents_of_one_form_are_columns():
    def read(docs):
        form = None
        for x in docs:
            form = N._merged(form, N._form(json.loads(x)))
        return N._as_columns(pa.array(docs), form)

    assert read(FORMS[0]) is not None and read(FORMS[3]) is not None
    assert N._as_columns(pa.array(['{"key": 7}', '{"key": "7"}']), {"key": pa.int64()}) is None
    assert N._as_columns(pa.array(['{"key": 7, "key": 8}']), {"key": pa.int64()}) is None
    assert N._as_columns(pa.array(['{"key": 7}']), {"key": pa.string()}) is None
