import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm.graph import _stars, components


@pytest.mark.parametrize(("hot", "chunk"), [(512, 1 << 16), (512, 60), (5, 25), (5, 1)])
def test_components_of_chains_stars_and_rings(spark, hot, chunk):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(k, (k - 200 + 7) % 30 + 200) for k in range(200, 230)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    want = {(x, top(x)) for a, b in edges if a != b for x in (a, b)}
    rows = components(spark.createDataFrame(edges, "a long, b long"), hot=hot, chunk=chunk).collect()
    assert len(rows) == len(want) and {(r["node"], r["root"]) for r in rows} == want


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(1, 1), (None, 2), (3, None)], "a long, b long")).count() == 0


def test_a_task_turns_its_edges_into_stars():
    chain = np.random.default_rng(3).permutation(5000)
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    (found,) = _stars(iter([batch(chain[1:2500], chain[:2499]), batch([], []), batch(chain[2501:] + 10**6, chain[2500:-1] + 10**6)]))
    got = dict(zip(found["a"].to_pylist(), found["b"].to_pylist()))
    low, high = chain[:2500], chain[2500:] + 10**6
    assert got == {int(x): int(low.min()) for x in low if x != low.min()} | {int(x): int(high.min()) for x in high if x != high.min()}
    assert not list(_stars(iter([])))
