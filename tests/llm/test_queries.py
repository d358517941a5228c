"""Each registered query, run over a folder of tables and held against its SQL or a direct computation.

op4, op7, op8, op9 and op10 have such tests beside their operators' tests.
"""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality_lm as L
from tidemark.llm import sentencepiece_codec as S
from tidemark.llm import registry

from . import test_quality_lm as lm
from . import test_quality_rules as rules
from . import test_sentencepiece_codec as codec
from .conftest import ODD, prose
from .test_ngram_join import changed
from .test_substring_dedup import planted

SF = "/root/testdata/sf0.001"


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with copies, near copies, shared passages, junk, odd rows and a null id; labels of some."""
    from .conftest import DOCS

    base = prose(1, 90)
    rows = [(k, prose(k, 60 + k)) for k in range(100, 160)] + [(300 + k, changed(base, k % 6, k)) for k in range(12)]
    rows += [(500 + i, x) for i, x in planted(2) if i is not None] + [(None, planted(2)[13][1]), *((i if i is None else 900 + i, x) for i, x in ODD[:4] + ODD[5:])]
    rows += [(700 + k, " ".join(w[::-1] + "%" for w in prose(k, 60).split())) for k in range(10)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, x, "en" if (i or 0) % 2 else "de", "s", None if x is None else len(x)) for i, x in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 700), 0) for k in (*range(100, 160), *range(700, 710))], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def same(spark, name, path, tables):
    df = registry.QUERIES[name](spark, path)
    con = duckdb.connect()
    for t in tables:
        found = f"{path}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{found + '/*.parquet' if os.path.isdir(found) else found}'")
    want = con.sql(registry.ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    rows = lambda cols, found: sorted((tuple(r[cols.index(c)] for c in order) for r in found), key=str)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["op5_substring_dedup", "op6_ngram_join", "op8_mixing"])
def test_matches_sql_on_odd_rows(spark, folder, name):
    same(spark, name, folder[0], ["documents"])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql_on_tables(spark, name):
    same(spark, name, SF, ["documents", "pages", "benchmark"])


def test_op3_counts_and_decisions(spark, folder):
    path, rows = folder
    got = registry.QUERIES["op3_quality_rules"](spark, path).collect()
    want = sorted((str(i), *rules.brute(x)) for i, x in rows)
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.2)
        if r["doc_id"] in range(100, 160) or r["doc_id"] in range(700, 710):
            assert r["kept"] == (r["doc_id"] < 700)


@pytest.mark.skipif(not os.path.exists(S.MODEL), reason="no public vocabulary file here")
def test_op2_ids(spark, folder):
    path, rows = folder
    v, text = S.load(), {}
    for i, x in rows:
        text.setdefault(i, []).append(x)
    for r in registry.QUERIES["op2_sentencepiece"](spark, path).collect():
        x = text[r["doc_id"]]
        assert r["n_tokens"] == len(r["ids"] or [])
        assert r["round_trip"] if r["ids"] is not None else None in x
        if r["ids"] is not None:
            assert S.decode(r["ids"], v) in x
            if len(r["ids"]) < 400:
                plain = (" " + S.decode(r["ids"], v)).replace(" ", S.SPACE)
                assert r["ids"] == (codec.whole(plain, v) if plain != S.SPACE else [])


def test_op1_perplexities_and_thresholds(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    good = [(i, x) for i, x in rows if i in range(100, 160)]
    held = {r["id"] for r in spark.range(1000).where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(L.FOLDS)) == 0).collect()}
    vocab = L.vocabulary(docs.select("text"))
    want, *_ = lm.brute([x or "" for _, x in rows], [x for i, x in good if i not in held], vocab)
    told = {}
    for (i, _), (n, lp) in zip(rows, want):
        told.setdefault(i, []).append((n, lp))
    got = registry.QUERIES["op1_quality_classifier"](spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        near = [np.exp(-lp / n) for n, lp in told[r["doc_id"]] if n == r["n_words"] and n]
        assert r["perplexity"] == pytest.approx(near[0], rel=2e-3) if near else r["perplexity"] is None
        assert r["kept"] == (r["perplexity"] is not None and r["perplexity"] <= r["threshold"])
    # Fewer held-out documents than a language needs: all languages' quantile, here the greatest of them.
    trusted = [r["perplexity"] for r in got if r["doc_id"] in held and r["doc_id"] in dict(good)]
    assert {r["threshold"] for r in got} == {max(trusted)}
    assert not any(r["kept"] for r in got if r["doc_id"] in range(700, 710))
