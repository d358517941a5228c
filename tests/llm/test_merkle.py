"""Manifests against a plain construction of the same trees."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle as M
from tidemark.llm import registry

from .conftest import ODD
from .test_queries import same


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def path(tree, at):
    near, steps = [], []
    for level in tree[:-1]:
        run = level[at // 16 * 16 : at // 16 * 16 + 16]
        near += run[: at % 16] + run[at % 16 + 1 :]
        steps.append((at % 16, run))
        at //= 16
    return near, steps


def brute(rows, claimed):
    """rows: (doc_id, source, lang, n_chars, text); claimed: the texts that are checked."""
    first = lambda x: (x is not None, x if x is not None else 0)
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, members = [], []
    for s in sources:
        mine = sorted(((r, c) for r, c in zip(rows, claimed) if r[1] == s), key=lambda x: (first(x[0][0]), leaf(x[0]), leaf((*x[0][:4], x[1]))))
        members.append(mine)
        trees.append(levels([leaf(r) for r, _ in mine]))
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, (mine, tree) in enumerate(zip(members, trees)):
        for at, (r, c) in enumerate(mine):
            (near, steps), (near_top, steps_top) = path(tree, at), path(top, k)
            folded = leaf((*r[:4], c))
            for position, run in steps + steps_top:
                folded = h(*run[:position], folded, *run[position + 1 :])
            out.append((r[0], leaf(r), tree[-1][0], top[-1][0], h(*near, *near_top), folded, folded == top[-1][0]))
    return out


def table(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{path}/documents.parquet")


def case(sizes):
    rows = []
    for k, (source, n) in enumerate(sizes):
        rows += [(1000 * k + i, source, "en" if i % 3 else None, i, f"Text {i} OF {source} é") for i in range(n)]
    return rows


CASES = {
    "one leaf": case([("a", 1)]),
    "one tree": case([("a", 300)]),
    "lone leaves": case([("a", 1), (None, 1), ("b", 1)]),
    "uneven": case([("a", 17), (None, 16), ("é", 257), ("Z", 1), ("b", 33)]),
    "many sources": case([(f"s{k}", k % 3 + 1) for k in range(40)]),
    "odd": [(i, "x" if (i or 0) % 2 else None, None, None, t) for i, t in ODD] + [(None, None, None, None, None)] * 2,
}


@pytest.mark.parametrize("name", CASES)
def test_query_equals_plain_trees_and_sql(spark, tmp_path, name):
    rows = CASES[name]
    table(spark, rows, tmp_path)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    claimed = [r[4].translate(lower) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[4] for r in rows]
    got = registry.QUERIES["op12_merkle"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows, claimed)))
    if len(rows) < 100 or name == "uneven":
        same(spark, "op12_merkle", str(tmp_path), ["documents"])


def test_every_tampered_row_is_found_and_no_other(spark):
    rows = case([("a", 700), ("b", 40)])
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    changed = F.when(F.col("doc_id") % 50 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    found = M.verify(docs, {"text": changed}, proofs=True)
    for r in found.collect():
        assert r["verified"] == (r["doc_id"] % 50 != 7)
        assert M.node_digest(r["proof"]) == r["proof_sha256"] and len({r["root"]}) == 1
    assert found.select("root").distinct().count() == 1


def test_other_columns_keys_and_trees(spark, make):
    docs = make([(k, f"t{k}", "en" if k % 2 else "de") for k in range(50)], clash=True)
    got = M.verify(docs, columns=("text",), tree="lang", key="doc_id").collect()
    assert len(got) == 50 and all(r["verified"] for r in got) and len({r["subroot"] for r in got}) == 2
    assert {r["leaf"] for r in got} == {leaf((f"t{k}",)) for k in range(50)}


def test_empty_table(spark, make):
    assert M.verify(make([])).count() == 0


def test_a_lost_child_is_noticed():
    with pytest.raises(ValueError, match="has 2 of its children"):
        M._completed(((0, 0), [(3, 0, "a", None), (3, 2, "c", None)]))
