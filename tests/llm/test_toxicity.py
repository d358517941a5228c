import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity as X

from .conftest import ODD, prose


def labelled_docs(n=300):
    rows, marks = [], []
    for k in range(n):
        bad = k % 4 == 0
        text = prose(k, 40) + (" you " + " ".join(["vilesnark", "grubtoad", "muckhead"][(k + j) % 3] for j in range(3)) if bad else "")
        rows.append((k, text))
        marks.append((k, int(bad)))
    return rows, marks


def test_held_out_accuracy_and_evidence(spark, make):
    rows, marks = labelled_docs()
    learn = spark.createDataFrame([m for m in marks if m[0] % 3], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in X.score(make(rows, clash=True), learn).collect()}
    test = [m for m in marks if m[0] % 3 == 0]
    assert np.mean([(got[i]["score"] >= 0.3) == bool(t) for i, t in test]) > 0.97
    assert all(set(got[i]["evidence"]) <= {k for k, _ in marks if k % 3} for i, _ in test)


def test_block_max_search_is_exact(monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 16)
    rows, marks = labelled_docs(400)
    ids, texts = np.array([r[0] for r in rows]), pa.array([r[1] for r in rows])
    tox = np.array([bool(m[1]) for m in marks])
    index = X.fit(ids, texts, tox, (300, 100))
    doc, term, tf, n = X.counts(texts, index["vocabulary"])
    w = X._weights(doc, term, tf, n, index["idf"])
    dense = np.zeros((n, max(1, len(index["vocabulary"]))))
    dense[doc, term] = w
    cosine = dense @ dense.T
    skipped = 0
    for i in np.flatnonzero(np.bincount(doc, minlength=n)):
        part = doc == i
        found, c = X.nearest(index, term[part], w[part], 10)
        order = np.lexsort((ids, -np.round(cosine[i], 10)))
        order = order[np.round(cosine[i][order], 10) > 0][:10]
        read = X.cosines(index, np.zeros(part.sum(), np.int64), term[part], w[part], 1, 10)[0]
        skipped += int(((read == 0) & (cosine[i][index["ids"]] > 1e-9)).sum())
        assert index["ids"][found].tolist() == ids[order].tolist() and np.allclose(c, cosine[i][order])
    assert skipped > 0


def test_weights_are_tf_idf_of_unit_length():
    texts = pa.array(["aaa bbb aaa", "bbb", None])
    vocabulary = np.sort(np.unique(X.terms(texts)[0]))
    doc, term, tf, n = X.counts(texts, vocabulary)
    idf = np.linspace(1, 2, len(vocabulary))
    w = X._weights(doc, term, tf, n, idf)
    raw = [(1 + math.log(c)) * idf[t] for t, c in sorted(Counter(term[doc == 0].repeat(tf[doc == 0])).items())]
    assert np.allclose(w[doc == 0], np.array(raw) / np.linalg.norm(raw)) and n == 3


def test_case_folding_and_prefixes():
    a, b = (set(X.terms(pa.array([x]))[0].tolist()) for x in ("ÉCOLES Straßen", "écoles straßen"))
    assert a == b
    c = set(X.terms(pa.array(["stra ßen"]))[0].tolist())
    assert not (c & {int(x) for x in X.terms(pa.array(["strabc"]))[0]} - c)


def test_odd_rows_no_labels_and_empty_table(spark, make):
    rows, marks = labelled_docs(80)
    learn = spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, toxic int")
    got = X.score(make(rows + [(1000 + (i or 0), x) for i, x in ODD] + [(None, "grubtoad")]), learn).collect()
    assert len(got) == len(rows) + len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in X.score(make(rows[:5]), none).collect()} == {0.0}
    assert X.score(make([]), learn).count() == 0


def test_held_out_rule(spark):
    import zlib

    got = spark.range(200).select("id", X.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def test_terms_of_most_toxic_examples_and_of_few_examples_count(spark, make):
    """A word of every toxic example, and one of a single example, are neighbours' terms."""
    rows = [(k, f"{prose(k, 30)} grubtoad" if k % 2 else prose(k, 30)) for k in range(40)]
    rows[3] = (3, rows[3][1] + " quizzwort")
    asked = [(100, "grubtoad"), (101, "quizzwort")]
    learn = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in X.score(make(rows + asked), learn).collect()}
    assert len(got[100]["evidence"]) == X.K and all(i % 2 for i in got[100]["evidence"]) and got[100]["score"] > 0.5
    assert got[101]["evidence"] == [3]


def test_document_counts_cover_all_documents(make):
    rows = [(k, f"word{k} shared") for k in range(50)] + [(50, None)]
    vocabulary = X.vocabulary(X.held_terms(pa.array(["shared word7 absent"])))
    df, n = X._frequencies(make(rows).select("text"), vocabulary)
    of = lambda w: df[np.searchsorted(vocabulary, X.terms(pa.array([w]))[0][0])]
    assert n == 51 and (of("shared"), of("word7"), of("absent")) == (50, 1, 0)


def test_labels_do_not_decide_their_own_documents(spark, make):
    """Flipping the label of one example changes neither its own score much, nor that of a row with its text."""
    rows, marks = labelled_docs(120)
    rows.append((900, rows[8][1]))
    one = {r["doc_id"]: r for r in X.score(make(rows), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()}
    flipped = [(k, 1 - t if k == 8 else t) for k, t in marks]
    two = {r["doc_id"]: r for r in X.score(make(rows), spark.createDataFrame(flipped, "doc_id long, toxic int")).collect()}
    assert one[8]["score"] == one[900]["score"] > 0.5 and two[8]["score"] == two[900]["score"] > 0.5
    assert 8 not in one[8]["evidence"] and 8 not in one[900]["evidence"]


def test_conflicting_labels_and_texts_are_settled_alike_each_time(spark, make):
    rows, marks = labelled_docs(80)
    twice = [(4, "another text of four"), (5, "grubtoad muckhead")]
    learn = [*marks, (8, 0), (9, 1)]
    one, two = (sorted((r["doc_id"], r["score"], tuple(r["evidence"])) for r in X.score(make(d), spark.createDataFrame(m, "doc_id long, toxic int")).collect()) for d, m in ((rows + twice, learn), (twice + rows[::-1], learn[::-1])))
    assert one == two and all(8 not in e and 9 not in e for _, _, e in one)


def test_scores_are_calibrated(spark, make):
    """A word that is toxic three times out of five, one that is one time out of ten: scores say so on held-out texts."""
    import random

    rng, rows, marks = random.Random(3), [], []
    for k in range(900):
        word, rate = (("grubtoad", 0.6), ("quizzwort", 0.1))[k % 2]
        rows.append((k, f"{word} {word} {prose(k, 6)}"))
        marks.append((k, int(rng.random() < rate)))
    learn = spark.createDataFrame([m for m in marks if m[0] % 3], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in X.score(make(rows), learn, k=60).collect()}
    for low, high in ((0.0, 0.3), (0.3, 1.0)):
        part = [(got[i], t) for i, t in marks if i % 3 == 0 and low <= got[i] < high]
        assert len(part) > 100 and abs(np.mean([s for s, _ in part]) - np.mean([t for _, t in part])) < 0.08


def test_query_matches_a_direct_computation(spark, make, tmp_path):
    """Scores, evidence and decisions of the registered query from cosines of full matrices."""
    import zlib

    from tidemark.llm.registry import QUERIES

    rows, marks = labelled_docs(160)
    rows += [(1000 + (i or 0), x) for i, x in ODD]
    marks += [(1004, 0), (2000, 1)]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in marks], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    known = {i: t for i, t in marks if not out(i) and i in dict(rows)}
    text = {i: x for i, x in rows if i in known}
    ids = sorted(known, key=lambda i: (known[i], i))
    held = X.held_terms(pa.array([text[i] for i in ids]))
    vocabulary = {h: j for j, h in enumerate(sorted({int(h) for hs, _ in held for h in hs}))}
    own = [X.held_terms(pa.array([x]))[0] for _, x in rows]
    df = np.zeros(len(vocabulary))
    for hs, _ in own:
        for h in hs:
            if int(h) in vocabulary:
                df[vocabulary[int(h)]] += 1

    def vectors(many, idf):
        m = np.zeros((len(many), len(vocabulary)))
        for i, (hs, ns) in enumerate(many):
            for h, n in zip(hs, ns):
                if int(h) in vocabulary:
                    m[i, vocabulary[int(h)]] = (1 + np.log(n)) * idf[vocabulary[int(h)]]
        return m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None]

    toxic = np.array([bool(known[i]) for i in ids])
    there = vectors(held, np.ones(len(vocabulary))) > 0
    # Twice (2000 is labelled, but no document): classes weigh as many labelled documents as there are.
    n1, n0 = sum(t for i, t in marks if not out(i)), sum(1 - t for i, t in marks if not out(i))
    contrast = X.contrast(there[toxic].sum(0), there[~toxic].sum(0), toxic.sum(), (~toxic).sum())
    idf = (np.log((len(rows) + 1) / (df + 1)) + 1) * contrast
    cosine = vectors(own, idf) @ vectors(held, idf).T
    stands = np.where(toxic, n1 / toxic.sum(), n0 / (~toxic).sum())
    stands = stands / stands.mean()
    prior = n1 / (n1 + n0)

    def share(row, x):
        order = [j for j in np.lexsort((ids, -np.round(row, 10))) if row[j] > 1e-12 and text[ids[j]] != x][: X.K]
        w = np.round(row[order], 10) ** X.POWER * stands[order]
        return ((w[toxic[order]].sum() + X.PRIOR * prior) / (w.sum() + X.PRIOR) if order else prior), [ids[j] for j in order]

    loo = np.array([share(vectors([held[j]], idf)[0] @ vectors(held, idf).T, text[i])[0] for j, i in enumerate(ids)])
    curve = X.calibration(loo, toxic, stands)
    got = {}
    for r in QUERIES["op7_toxicity"](spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for (i, x), row in zip(rows, cosine):
        s, evidence = share(row, x)
        want = float(X.calibrated(curve, np.array([s]))[0])
        r = got[i][0]
        assert r["score"] == pytest.approx(want, abs=1e-6) and sorted(r["evidence"]) == sorted(evidence)
        assert r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == out(i)
