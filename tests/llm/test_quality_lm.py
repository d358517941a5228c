import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import quality_lm as L

from .conftest import ODD, prose


def corpus():
    good = [(k, prose(k, 60)) for k in range(120)]
    bad = [(500 + k, " ".join(w[::-1] + "%" for w in prose(k, 60).split())) for k in range(15)]
    return good, bad


def brute(texts, trained, vocab):
    """Log probabilities of the texts by direct Kneser-Ney over the same ids."""
    import pyarrow as pa

    from tidemark.llm.tokens import text_buffer, words

    def ids(x):
        buf, off = text_buffer(pa.array([x]))
        s, e, _ = words(buf, off)
        return L.token_ids(buf, s, e, L.by_hash(vocab)).tolist()

    pairs = Counter()
    for x in trained:
        w = [L.START, *ids(x)]
        pairs.update(zip(w, w[1:]))
    often = Counter(pairs.values())
    d = L.discounts(*[float(often.get(k, 0)) for k in (1, 2, 3, 4)])
    contexts = defaultdict(set)
    for v, w in pairs:
        contexts[w].add(v)
    size = len(vocab) + L.SHAPES
    n = np.array([len(contexts.get(k, ())) for k in range(size)])
    q = L.lower_order(n, size)
    total, held = Counter(), defaultdict(float)
    for (v, _), c in pairs.items():
        total[v] += c
        held[v] += d[min(c, 3)]
    out = []
    for x in texts:
        w, lp = [L.START, *ids(x)], 0.0
        for v, y in zip(w, w[1:]):
            p = q[y]
            if total[v]:
                c = pairs.get((v, y), 0)
                p = max(c - d[min(c, 3)], 0) / total[v] + held[v] / total[v] * q[y]
            lp += math.log(p)
        out.append((len(w) - 1, lp))
    return out, q, d, pairs


@pytest.mark.parametrize("group_words", [L.GROUP_WORDS, 20])
def test_matches_direct_model(spark, make, monkeypatch, group_words):
    from pyspark.sql import functions as F

    monkeypatch.setattr(L, "GROUP_WORDS", group_words)

    good, bad = corpus()
    docs = make(good + bad, clash=True)
    trusted = spark.createDataFrame([(k,) for k, _ in good], "doc_id long")
    got = {r["doc_id"]: r for r in L.classify(docs, trusted).collect()}
    held = {r["id"] for r in spark.range(120).where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(L.FOLDS)) == 0).collect()}
    vocab = L.vocabulary(docs.select("text"))
    want, q, d, _ = brute([x for _, x in good + bad], [x for k, x in good if k not in held], vocab)
    assert 0 < len(held) < 60
    for (k, _), (n, lp) in zip(good + bad, want):
        assert got[k]["n_words"] == n and got[k]["log_prob"] == pytest.approx(lp, abs=n / 4000 + 1e-9)
    worst = max(got[k]["perplexity"] for k, _ in good)
    assert min(got[k]["perplexity"] for k, _ in bad) > worst


def test_probabilities_sum_to_one():
    good, _ = corpus()
    vocab = np.sort(np.array([], np.uint64))
    _, q, d, pairs = brute([], [x for _, x in good], vocab)
    assert q[: L.SHAPES].sum() == pytest.approx(1)
    codes = np.sort(np.array([v << L.WORD_BITS | w for v, w in pairs], np.uint64))
    counts = np.array([pairs[int(c) >> L.WORD_BITS, int(c) & L.START] for c in codes])
    for v in {int(c) >> L.WORD_BITS for c in codes}:
        asked = np.array([v << L.WORD_BITS | w for w in range(L.SHAPES)], np.uint64)
        assert np.exp(L.log_probabilities(codes, counts, asked, d, q)).sum() == pytest.approx(1)


def test_vocabulary_is_all_that_occurs_twice_or_the_commonest(make):
    docs = make([(1, "a a a b b c c d"), (2, "a e e")]).select("text")
    assert len(L.vocabulary(docs)) == 4 and len(L.vocabulary(docs, 3)) == 1 and len(L.vocabulary(docs, 4)) == 4
    assert L.vocabulary(docs, 3)[0] == L.vocabulary(docs)[0] and len(L.vocabulary(docs, 0)) == 0


def test_thresholds_by_language_reject_foreign_text(spark, make):
    good, bad = corpus()
    docs = make([(k, x, "en" if k % 2 else "de") for k, x in good] + [(k, x, "en") for k, x in bad])
    got = {r["doc_id"]: r for r in L.classify(docs, spark.createDataFrame([(k,) for k, _ in good], "doc_id long"), min_held=5).collect()}
    assert not any(got[k]["kept"] for k, _ in bad) and np.mean([got[k]["kept"] for k, _ in good]) > 0.95
    assert len({r["threshold"] for r in got.values()}) == 2


def test_odd_rows_no_trust_and_empty_table(spark, make):
    trusted = spark.createDataFrame([(4,), (8,), (None,)], "doc_id long")
    got = L.classify(make(ODD, clash=True), trusted).collect()
    assert len(got) == len(ODD) and all((r["perplexity"] is None) == (r["n_words"] == 0) for r in got) and not any(r["kept"] for r in got if r["n_words"] == 0)
    none = L.classify(make([(1, "a b"), (2, None)]), trusted.where("doc_id > 99")).collect()
    assert {r["doc_id"]: r["kept"] for r in none} == {1: True, 2: False}
    assert L.classify(make([]), trusted).count() == 0
