"""Weights, noise and ranks against a plain count of the same features."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import importance as I
from tidemark.llm import registry
from tidemark.llm.tokens import text_buffer

from .conftest import ODD, prose
from .test_queries import same


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def buckets(text, n=3, size=10_000):
    ws = tokens(text)
    return Counter(zlib.crc32(" ".join(ws[i : i + k]).encode()) % size for k in range(1, n + 1) for i in range(len(ws) - k + 1))


def brute(rows, target, n=3, size=10_000):
    source, wanted = Counter(), Counter()
    for _, x in rows:
        source.update(buckets(x, n, size))
    for x in target:
        wanted.update(buckets(x, n, size))
    s, t = sum(source.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + size) / ((source[b] + 1) * (t + size))))
    scored = []
    for i, x in rows:
        found = buckets(x, n, size)
        weight = sum(c * gain(b) for b, c in found.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append([i, sum(found.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(tokens(x))])
    able = sorted((r for r in scored if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2], r[4]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: 5 * len(able) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in scored]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    from .conftest import DOCS

    rng = random.Random(2)
    rows = [(k, prose(k, rng.randint(5, 120))) for k in range(300)] + [(400 + k, prose(1, 40) + " Ünï") for k in range(60)] + ODD
    rows += [(500, "Z" * 70 + " " + "y" * 300 + " end " + prose(9, 20_000)), (501, "w" * 70_000 + " " + "v" * 70_000 + " u")]
    target = [prose(1, 30), prose(900, 50), None, ""]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, x, "en", "s", None) for i, x in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(target)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, [x for x in target if x]


def test_query_equals_plain_counts_and_sql(spark, folder):
    path, rows, target = folder
    got = registry.QUERIES["op13_importance"](spark, path)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows, target)))


def test_query_equals_sql(spark, folder, tmp_path):
    """Without the texts of giant words, on which the SQL takes a step a byte."""
    path = folder[0]
    spark.read.parquet(f"{path}/documents.parquet").where("text IS NULL OR NOT text RLIKE '[a-z]{1000}'").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    same(spark, "op13_importance", str(tmp_path), ["documents", "benchmark"])


@pytest.mark.parametrize("chunk", [50, 5000])
def test_cuts_change_nothing(spark, folder, chunk):
    path, rows, target = folder
    docs, wanted = spark.read.parquet(f"{path}/documents.parquet"), spark.createDataFrame([(x,) for x in target], "text string")
    got = I.resample(docs.select("doc_id", F.col("text")), wanted, chunk=chunk).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows, target)))


def test_hashes_of_spans():
    texts = ["", "a", "A b", "é 中國 x", "y" * 64 + " " + "z" * 65 + " " + "q" * 5000, "1,2;3"]
    found, first = I.features(*text_buffer(pa.array(texts)))
    for k, x in enumerate(texts):
        ws = tokens(x)
        for size, (crc, real) in enumerate(found, 1):
            span = slice(first[k], first[k + 1])
            got = [int(c) for c, r in zip(crc[span], real[span]) if r]
            assert got == [zlib.crc32(" ".join(ws[i : i + size]).encode()) for i in range(len(ws) - size + 1)]


def test_draws_lean_towards_the_target(spark):
    """Documents like the target are drawn far more often, but noise lets others in at equal weights."""
    rows = [(k, " ".join(["alpha beta gamma delta"] * 6) if k % 10 == 0 else prose(k, 24)) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    drawn = I.resample(docs, spark.createDataFrame([("alpha beta gamma delta " * 50,)], "text string")).where("rank IS NOT NULL")
    assert drawn.count() == 100 and drawn.where("doc_id % 10 = 0").count() == 100
    plain = spark.createDataFrame([(k, "same words " * 12) for k in range(4000)], "doc_id long, text string")
    ids = [r["doc_id"] for r in I.resample(plain, plain.limit(0)).where("rank IS NOT NULL").collect()]
    assert len(ids) == 200 and 1500 < np.mean(ids) < 2500


def test_other_columns_and_empty_tables(spark, make):
    docs = make([(k, prose(k, 40)) for k in range(40)], clash=True).withColumns({"rank": F.lit("mine"), "_row": F.lit(1), "own": F.lit(2)})
    got = I.resample(docs, docs, keep=("lang", "target", "rank", "text"))
    assert got.columns == ["doc_id", "lang", "target", "text", *I.RESULTS] and got.where("target = 'x-target'").count() == 40
    assert sorted(r["rank"] for r in got.where("rank IS NOT NULL").collect()) == [1, 2]
    empty = I.resample(make([]), docs)
    assert empty.count() == 0
