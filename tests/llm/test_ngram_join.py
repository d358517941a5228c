import itertools
import random
import re

import pytest

from tidemark.llm import ngram_join as N

from .conftest import ODD, prose


def grams(x):
    w = re.findall(r"[^\x20\x09-\x0D]+", x or "")
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def changed(text, n, seed):
    rng, w = random.Random(seed), text.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = f"new{seed}x{k}"
    return " ".join(w)


def rows_():
    base = [prose(500 + k, 120) for k in range(4)]
    rows = [(k, prose(k, 30 + k)) for k in range(20)]
    rows += [(100 + 10 * b + k, changed(t, k % 5, 7 * k + b)) for b, t in enumerate(base) for k in range(8)]
    return rows + [(200, "one two"), (201, "one two"), (202, "two one"), (203, "one"), (204, "one")]


@pytest.mark.parametrize("side, part, fetched, wide", [(1024, 512, 2_000_000, 64), (3, 3, 0, 64), (3, 3, 0, 1)])
def test_matches_brute_force(make, monkeypatch, side, part, fetched, wide):
    monkeypatch.setattr(N, "WIDE", wide)
    monkeypatch.setattr(N, "SIDE", side)
    monkeypatch.setattr(N, "BAND_PART", part)
    monkeypatch.setattr(N, "MAX_FETCHED", fetched)
    rows = rows_() + [(i, x) for i, x in ODD]
    part = [(k, i, grams(x)) for k, (i, x) in enumerate(rows) if i is not None]
    links, up = {k: 0 for k, _, _ in part}, {k: k for k, _, _ in part}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for (a, _, x), (b, _, y) in itertools.combinations(part, 2):
        if x and y and len(x & y) / len(x | y) >= 0.8 - 1e-12:
            links[a] += 1
            links[b] += 1
            up[top(a)] = top(b)
    least = {}
    for k, i, _ in part:
        least[top(k)] = min(least.get(top(k), i), i)
    want = sorted((i, least[top(k)], links[k]) for k, i, _ in part)
    got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in N.similar(make(rows, clash=True)).collect()]
    assert sorted(g for g in got if g[0] is not None) == want
    assert [g for g in got if g[0] is None] == [(None, None, 0)]


def test_deduplicated_keeps_one_of_each_class(make):
    docs = make(rows_() + [(i if i is None else 1000 + i, x) for i, x in ODD], clash=True)
    out = N.deduplicated(docs)
    ids = sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None)
    found = {r["doc_id"]: r["class_id"] for r in N.similar(docs).collect() if r["doc_id"] is not None}
    assert out.columns == docs.columns and ids == sorted({c for c in found.values()})


def test_deduplicated_keeps_other_texts_of_a_repeated_id(make):
    """Id 1 stands on two equal texts, on a text of another class, and on one without links."""
    a, b, alone = prose(1, 60), prose(2, 60), prose(3, 60)
    docs = make([(1, a), (1, a), (2, a), (1, b), (3, b), (1, alone)], clash=True)
    assert sorted((r["doc_id"], r["text"]) for r in N.deduplicated(docs).collect()) == sorted([(1, a), (1, b), (1, alone)])


def test_deduplicated_is_the_same_each_time(make):
    """Near copies under one id: the one of the least text hash stays, whatever the order of rows."""
    a = prose(11, 80)
    rows = [(1, a), (1, a + " more"), (1, a + " again"), (2, a)]
    one, two = ([(r["doc_id"], r["text"]) for r in N.deduplicated(make(x)).collect()] for x in (rows, rows[::-1]))
    assert len(one) == 1 and one == two and one[0][0] == 1


def test_empty_table(make):
    assert N.similar(make([])).count() == 0 and N.deduplicated(make([])).count() == 0


def test_pruning_table_is_the_posterior_tail():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, m in N.least_matches(0.8, 1e-2):
        tail = lambda k: (rng.beta(k + 1, n - k + 1, 400_000) >= 0.8).mean()
        assert tail(m) > 0.008 and tail(m - 1) < 0.013


def shared_passage(n):
    """Documents of 100 words of their own and one passage of 30 words that all share; every 100th has a near copy."""
    passage = prose(999, 30)
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(100)) + " " + passage) for k in range(n)]
    return rows + [(n + k, x + " more") for k, x in rows[::100]]


def test_a_shared_passage_makes_no_candidates(make):
    from pyspark.sql import functions as F

    from tidemark.llm.shared import written

    pairs = {}
    for n in (1500, 3000):
        docs = make(shared_passage(n))
        texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
        classes = written(texts.mapInArrow(N._features, N._FEATURES), "t").select("key", F.struct("doc_id", "text_hash").alias("least"), "sig")
        pairs[n] = N.candidates(texts, classes, 0.8).groupBy("cluster").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).head()[0]
    assert pairs[1500] < 3000 and pairs[3000] <= 2.2 * pairs[1500], pairs
    out = N.similar(docs).where("n_links > 0").collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in out) == sorted([(k, k, 1) for k in range(0, 3000, 100)] + [(3000 + k, k, 1) for k in range(0, 3000, 100)])


def test_sets_that_reach_the_threshold_share_a_first_gram():
    """Under any order: here levels drawn at random, sets of random overlap."""
    import numpy as np

    rng = np.random.default_rng(3)
    met = 0
    for _ in range(3000):
        n, both = int(rng.integers(1, 30)), rng.permutation(60).astype(np.uint64)
        a, b = np.sort(both[:n]), np.sort(both[int(rng.integers(0, 3)) : n + int(rng.integers(0, 4))])
        if not len(b) or len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b)) - 1e-12:
            continue
        met += 1
        value, level = np.concatenate([a, b]), rng.integers(0, 4, 60)
        gram, of = N.first_grams(value, level[value.astype(int)], np.array([0, len(a), len(value)]), 0.8)
        assert set(gram[of == 0].tolist()) & set(gram[of == 1].tolist())
    assert met > 500
