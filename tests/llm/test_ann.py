import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann as A


def table(spark, v, ids=None):
    return spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(range(len(v)) if ids is None else ids, v)], "vec_id long, embedding array<float>")


def exact(v, q, k):
    s = (v[q][:, None, :] * v[None]).sum(2)
    out = {}
    for row, i in zip(s, q):
        row[i] = -np.inf
        order = np.lexsort((np.arange(len(v)), -row))[:k]
        out[int(i)] = [int(x) for x in order if np.isfinite(row[x])]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    c = rng.normal(size=(12, 16))
    return (c[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 16))).astype(np.float32).astype(np.float64) * rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)


def test_recall_and_order(spark, vectors):
    v = vectors.astype(np.float32).astype(np.float64)
    rows = A.search(table(spark, v), F.col("vec_id") % 20 == 0, k=10, list_size=75).collect()
    want = exact(v, np.arange(0, 3000, 20), 10)
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["score"] == pytest.approx(float((v[r["query_id"]] * v[r["vec_id"]]).sum()), abs=1e-12)
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    assert all([y[1] for y in x] == sorted((y[1] for y in x), reverse=True) for x in got.values())
    recall = np.mean([len({a for a, _ in got[i]} & set(want[i])) / 10 for i in want])
    assert recall >= 0.9


def test_ties_go_to_smaller_ids_in_a_hot_list(spark):
    v = np.ones((700, 4))
    got = A.search(table(spark, v), F.col("vec_id") == 3, k=5).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 4, 5]


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, float("nan")]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [0.5, 0.5]), (7, [0.5, 0.5]), (8, [1.0, 2.0, 3.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"list": F.lit(1), "v": F.lit("x"), "score": F.lit(0)})
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in A.search(df, F.lit(True), k=20).collect())
    # The shorter vectors count as (1, 0, 0) and (0.5, 0.5, 0).
    assert got == [(1, 1, 8, 1.0), (1, 2, 7, 0.5), (7, 1, 8, 1.5), (7, 2, 1, 0.5), (8, 1, 7, 1.5), (8, 2, 1, 1.0)]
    assert A.search(df.limit(0), F.lit(True)).count() == 0 and A.search(df.where("vec_id = 2"), F.lit(True)).count() == 0


def shapes():
    rng = np.random.default_rng(9)
    c = rng.normal(size=(400, 64))
    c /= np.linalg.norm(c, axis=1)[:, None]
    outlier = rng.normal(size=(3000, 16))
    outlier[20] *= 1000
    return {"tight": np.repeat(c, 12, axis=0) + 0.01 * rng.normal(size=(4800, 64)), "gauss": rng.normal(size=(5000, 64)), "outlier": outlier, "few": rng.normal(size=(15, 8))}


@pytest.mark.parametrize("name", ["tight", "gauss", "outlier", "few"])
def test_production_parameters_give_every_query_all_rows(spark, tmp_path, name):
    """Through the registered query, with its parameters."""
    from tidemark.llm.registry import QUERIES

    v = shapes()[name].astype(np.float32).astype(np.float64)
    n, path = len(v), str(tmp_path)
    table(spark, v).write.mode("overwrite").parquet(f"{path}/embeddings.parquet")
    got = {}
    for r in QUERIES["op4_ann"](spark, path).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    asked = np.arange(0, n, 20)
    want = exact(v, asked, 20)
    assert set(got) == set(asked.tolist()) and all(len(x) == min(20, n - 1) for x in got.values())
    assert np.mean([len(set(got[i]) & set(want[i])) / len(want[i]) for i in want]) >= 0.95


def test_lists_within_lists(spark):
    v = np.random.default_rng(5).normal(size=(3000, 8)).astype(np.float32).astype(np.float64)
    rows = A.search(table(spark, v), F.col("vec_id") % 20 == 0, k=10, list_size=16, max_lists=8, part=32, bin=256, asked=16).collect()
    want, got = exact(v, np.arange(0, 3000, 20), 10), {}
    for r in rows:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert all(len(got[i]) == 10 for i in want)
    assert np.mean([len(got[i] & set(want[i])) / 10 for i in want]) >= 0.85


def test_repeated_ids_count_once(spark):
    """Forty entries of one id stand nearest: the other ids still fill the ranks."""
    v = np.concatenate([np.ones((40, 4)), np.random.default_rng(6).normal(size=(30, 4))])
    ids = [7] * 40 + list(range(100, 130))
    rows = A.search(table(spark, v, ids), F.col("vec_id") >= 100, k=5).collect()
    for q in range(100, 130):
        own = v[ids.index(q)]
        best = {i: max(float(own @ x) for x, j in zip(v, ids) if j == i) for i in set(ids) - {q}}
        want = sorted(best, key=lambda i: (-round(best[i], 9), i))[:5]
        assert [r["vec_id"] for r in sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_graph_finds_nearest_centroids():
    rng = np.random.default_rng(2)
    g = A.Graph(rng.normal(size=(600, 8)))
    x = rng.normal(size=(300, 8))
    found, d2 = g.search(x, 5)
    true = np.argsort(A._distances(x, g.c), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found, true)]) > 0.97 and (np.diff(d2, axis=1) >= 0).all()
    assert all(len(set(row)) == 5 for row in found)
    one = A.Graph(np.zeros((1, 3)))
    assert one.search(np.ones((2, 3)), 4)[0].tolist() == [[0], [0]]


def test_centroids_are_balanced():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(4000, 4)) * 0.05, rng.normal(size=(400, 4)) * 3])
    c = A.balanced_centroids(x, 40)
    assert np.bincount(A._distances(x, c).argmin(1), minlength=40).max() < 8 * len(x) / 40
