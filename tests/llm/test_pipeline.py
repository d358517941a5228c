import os
import shutil
import tracemalloc

import pyarrow as pa
import pytest

import corpus_pipeline as C
from tidemark.llm import mixing, ngram_join, pii, quality_rules
from tidemark.llm import sentencepiece_codec as S

from .conftest import ODD, prose

pytestmark = pytest.mark.skipif(not os.path.exists(S.MODEL), reason="no public vocabulary file here")


def test_stages_compose_on_odd_rows(spark, make, tmp_path):
    rows = [(100 + k, prose(k, 60), "en", "ab"[k % 2]) for k in range(30)] + [(200, prose(3, 60)), (201, "junk%%% " * 50)] + list(ODD)
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = {(r["doc_id"], tuple(r["ids"])) for r in C.run(spark, str(tmp_path)).collect()}
    # The same from the operators one by one, collected in between.
    again = lambda df: spark.createDataFrame(df.collect(), docs.schema)
    x = again(quality_rules.filter_quality(docs))
    ids = {r["doc_id"] for r in x.collect()}
    assert {100 + k for k in range(30)} <= ids and not ids & {1, 2, 3, 201}
    x = again(ngram_join.deduplicated(x))
    assert 200 not in {r["doc_id"] for r in x.collect()}
    x = again(mixing.mix(again(pii.sanitise(x, length="n_chars"))))
    found, name = S.encode(x)
    assert out == {(r["doc_id"], tuple(r[name]["ids"])) for r in found.collect()}


def test_stage_columns(spark, make):
    docs = make([(k, prose(k, 40)) for k in range(6)])
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
    assert len(C.STAGES) == 5 and shutil is not None


def test_empty_documents(spark, make, tmp_path):
    make([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_texts_pass_to_python_in_small_batches(spark, make):
    """10,000 texts of 3 KB in one batch are 30 MB in each task's worker, and more in the JVM outside its heap."""
    keys = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    old = {k: spark.conf.get(k, None) for k in keys}
    sized = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    large = spark.range(0, 6000, 1, 1).selectExpr("repeat(cast(id as string), 800) AS text")
    docs = make([(k, prose(k, 40)) for k in range(3)])
    try:
        for name, stage in C.STAGES:
            if name == "mixing":  # runs no Python on executors
                continue
            for k in keys:
                spark.conf.unset(k)
            stage(spark, docs, "")
            assert max(r["n"] for r in large.mapInArrow(sized, "n long").collect()) < 5e6, name
        spark.conf.set(keys[0], "123456")
        pii.sanitise(docs)
        assert spark.conf.get(keys[0]) == "123456"
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_worker_holds_little_besides_its_batch():
    """Running sums and hashes take some 100 bytes for each text byte of a piece."""
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(2000)), "text_hash": list(range(2000)), "text": [prose(k, 250) for k in range(2000)]})
    docs = batch.select(["text_hash", "text"])
    most = {}
    for name, rows in (("terms", lambda: pii._distinct_terms([docs])), ("counts", lambda: pii._counted(None)([docs.select(["text"])])), ("n-grams", lambda: ngram_join._features([batch]))):
        tracemalloc.start()
        for _ in rows():
            pass
        most[name] = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
    assert max(most.values()) < 45, most
