import math
from collections import Counter, defaultdict

import pytest

from tidemark.llm import mixing as M

from .conftest import ODD, prose


def fill(sizes):
    """Targets by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(out.values())
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return out


def rows_():
    return [(k, prose(k, 20 + k % 37), "en", ["a", "b", "c", "é", "Z", None][k % 6] if k % 4 else "a") for k in range(400)]


def test_targets_and_taken(make):
    rows = rows_()
    got = M.copies(make(rows, clash=True)).collect()
    assert len(got) == len(rows)
    size, taken = defaultdict(int), defaultdict(int)
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["n_copies"] * r["size"]
        assert 0 <= r["n_copies"] <= 2
    want = fill(size)
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for s in size:
        assert abs(taken[s] - want[s]) <= 30


def test_reruns_agree_and_seeds_differ(make):
    docs = make(rows_())
    pick = lambda seed: sorted((r["doc_id"], r["n_copies"]) for r in M.copies(docs, seed=seed).collect())
    assert pick(1) == pick(1) != pick(2)


def rates(sizes, left):
    """p of each size by filling up: proportional to the root, 1 at most, expected words as left."""
    root, full = {s: math.ceil(math.sqrt(s)) for s in sizes}, set()
    while True:
        rate = (left - sum(s * n for s, n in sizes.items() if s in full)) / sum(s * n * root[s] for s, n in sizes.items() if s not in full)
        over = {s for s in sizes if s not in full and rate * root[s] > 1}
        if not over:
            return {s: 1.0 if s in full else rate * root[s] for s in sizes}
        full |= over


def test_each_document_is_included_by_its_own_probability(make):
    """300 sources hold the same sizes under other ids: their shares taken are draws of one document each."""
    lengths = [4, 9, 16, 25, 49, 100, 100, 225] * 20
    docs = make([(1000 * k + i, "w " * n, "en", f"s{k:03}") for k in range(300) for i, n in enumerate(lengths)])
    got = M.copies(docs).collect()
    sizes = Counter(lengths)
    hits, seen, told = defaultdict(int), defaultdict(int), {}
    for r in got:
        key = (int(r["source"][1:]) % 3, r["size"])
        whole = int(r["target"] // r["source_size"])
        hits[key] += r["n_copies"] - whole
        seen[key] += 1
        told[key] = (r["p"], r["target"] - whole * r["source_size"])
    for c in range(3):
        left = told[c, 100][1]
        want = rates(sizes, left) if left > 0 else dict.fromkeys(sizes, 0.0)
        for s in sizes:
            assert told[c, s][0] == pytest.approx(want[s])
            assert abs(hits[c, s] / seen[c, s] - want[s]) < 0.03, (c, s, hits[c, s] / seen[c, s], want[s])
    assert any(0.05 < told[c, 4][0] < told[c, 25][0] < 0.99 for c in range(3))


def test_query_agrees_with_its_sql(spark, make, tmp_path):
    import duckdb

    from tidemark.llm.registry import ORACLES, QUERIES

    rows = [*rows_(), *[(900 + k, "long " * 3000 * k, "en", "a") for k in range(4)], (990, None, "en", "Z"), (991, "", "en", "only empty")]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["op8_mixing"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(ORACLES["op8_mixing"])
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


def test_mix_repeats_rows(make):
    docs = make(rows_(), clash=True)
    n = {r["doc_id"]: r["n_copies"] for r in M.copies(docs).collect()}
    seen = defaultdict(int)
    out = M.mix(docs)
    for r in out.collect():
        seen[r["doc_id"]] += 1
    assert out.columns == docs.columns and dict(seen) == {k: v for k, v in n.items() if v}


def test_odd_rows_and_empty_table(make):
    got = M.copies(make(ODD, clash=True)).collect()
    assert len(got) == len(ODD) and all(r["n_copies"] == 0 for r in got if r["size"] == 0)
    assert M.copies(make([])).count() == 0 and M.mix(make([])).count() == 0
    assert all(r["n_copies"] == 0 for r in M.copies(make([(1, None), (2, "")])).collect())
