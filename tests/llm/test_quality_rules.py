import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality_rules as Q

from .conftest import ODD, prose


def brute(x):
    x = x or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    c, cov = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
    for i in range(len(w) - 7):
        if c[tuple(w[i : i + 8])] > 1:
            cov.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in x.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in x), dup, len(cov)


def test_counts_match_brute_force(make):
    rows = [*ODD, (20, "a b c d e f g h i a b c d e f g h j"), (21, "x\ny\nx\n\n \nx"), (22, "#*$ %&| <> é#")]
    out, q = Q.with_quality(make(rows, clash=True))
    got = sorted((r["text"] or "", tuple(r[q][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for r in out.collect())
    assert got == sorted((x or "", brute(x)) for _, x in rows)


def test_junk_goes_and_clean_text_stays(make):
    clean = [(k, prose(k, 80)) for k in range(60)]
    junk = [(100 + k, " ".join(w + "%%%" for w in prose(k, 60).split())) for k in range(8)] + [(120, "of " * 90), (121, "too short")]
    kept = {r["doc_id"] for r in Q.filter_quality(make(clean + junk, clash=True)).collect()}
    assert kept == set(range(60))


def test_columns_pass_unchanged(make):
    docs = make([(k, prose(k, 50)) for k in range(5)], clash=True)
    out = Q.filter_quality(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))


def test_empty_table(make):
    assert Q.filter_quality(make([])).count() == 0


def test_em_recovers_accuracies():
    rng = np.random.default_rng(3)
    good = rng.random(20_000) < 0.8
    a, b = np.array([0.99, 0.97, 0.95, 0.99]), np.array([0.7, 0.6, 0.8, 0.5])
    right = rng.random((20_000, 4)) < np.where(good[:, None], a, b)
    votes = np.where(right, np.where(good[:, None], 1, -1), np.where(good[:, None], -1, 1)) * (rng.random((20_000, 4)) < 0.9)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    m = Q.fit_label_model(patterns, n.astype(float))
    assert abs(m["share"] - 0.8) < 0.03 and np.abs(m["right_good"] - a).max() < 0.02 and np.abs(m["right_bad"] - b).max() < 0.06
    guess = Q.posterior_log_odds(votes, m["right_good"], m["right_bad"], m["share"]) > 0
    assert (guess == good).mean() > 0.95


def test_base_rule_is_exact(make):
    out, q = Q.with_quality(make([(1, "w " * 19), (2, prose(2, 20)), (3, "a b c d e f g h " * 2 + " ".join(map(str, range(38))))]))
    got = {r["doc_id"]: r["x"] for r in out.select("doc_id", F.col(q)["base_failed"].alias("x")).collect()}
    n = brute("a b c d e f g h " * 2 + " ".join(map(str, range(38))))
    assert got == {1: True, 2: False, 3: 100 * n[4] > 30 * n[0]}


def test_prose_of_other_languages_is_no_bad_vote(make):
    """Polish, Russian and Greek: few of the known function words, but short words; a run of long junk has neither."""
    polish = "To jest pies i kot w domu na ulicy, a my nie wiemy, co on tu robi i po co mu to było. " * 2
    russian = "Это не та книга, о чём он мне и вам тут всё же так долго и не раз говорил на той неделе. " * 2
    greek = "Και να που δεν είναι το ίδιο με το άλλο, που μας είπε ότι θα το δει και αυτό στο σπίτι του. " * 2
    junk = " ".join(f"qxzv{k}wwjkq" for k in range(40))
    out, q = Q.with_quality(make([(1, polish), (2, russian), (3, greek), (4, junk)]))
    votes = {r["doc_id"]: r["v"][8] for r in out.select("doc_id", F.col(q)["votes"].alias("v")).collect()}
    assert list(Q.rule_votes(lambda k: F.col(k)))[8] == "common_words"
    assert votes[4] == -1 and all(votes[k] >= 0 for k in (1, 2, 3))
