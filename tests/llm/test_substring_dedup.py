import re

import numpy as np
import pytest

from tidemark.llm import packed
from tidemark.llm.packed import split_by_shard
from tidemark.llm.substring_dedup import remove_repeats

from .conftest import ODD, prose


def brute(rows, size=13):
    ws, least = [re.findall(r"[^\x20\x09-\x0D]+", x or "") for _, x in rows], {}
    rank = [i if i is not None else float("inf") for i, _ in rows]
    for i, w in zip(rank, ws):
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            least[key] = min(least.get(key, float("inf")), i)
    out = []
    for (i, _), r, w in zip(rows, rank, ws):
        gone = {p for k in range(len(w) - size + 1) if i is not None and least[tuple(w[k : k + size])] < r for p in range(k, k + size)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def planted(seed):
    a, b = prose(900 + seed, 40), prose(950 + seed, 13)
    rows = [(k, prose(k + 100 * seed, 50 + k)) for k in range(12)]
    rows += [(20 + k, prose(20 + k, 11 + k) + " " + a + " " + prose(40 + k, k)) for k in range(6)]
    rows += [(30, b), (31, b + " tail"), (32, " ".join(b.split()[:12])), (33, a + " " + a), (29, " ".join(a.split()[3:17]))]
    # Ids are null: such documents neither lose words nor take any.
    return [*rows, (None, a), (None, prose(990 + seed, 30)), (34, prose(990 + seed, 30))]


@pytest.mark.parametrize("seed, most_sets, merged", [(0, 1 << 28, 1 << 22), (1, 1 << 28, 1 << 22), (0, 0, 1 << 22), (1, 0, 50)])
def test_matches_brute_force(make, monkeypatch, seed, most_sets, merged):
    monkeypatch.setattr(packed, "MOST_SETS", most_sets)
    monkeypatch.setattr(packed, "MERGED", merged)
    monkeypatch.setattr(packed, "BLOCK_BYTES", 1 << 21 if most_sets else 2000)
    monkeypatch.setattr(packed, "MOST_BLOCK_BYTES", 1 << 25 if most_sets else 2000)
    rows = planted(seed) + [(i, x) for i, x in ODD]
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in remove_repeats(make(rows, clash=True)).collect()]
    key = lambda t: (t[0] is None, t[0] or 0, t[3])
    assert sorted(got, key=key) == sorted(brute([r[:2] for r in rows]), key=key)


def test_other_window_and_empty_table(make):
    rows = [(1, "a b c d e"), (2, "x b c d y"), (3, "b c d")]
    got = {(r["doc_id"], r["kept"]) for r in remove_repeats(make(rows), window=3).collect()}
    assert got == {(1, "a b c d e"), (2, "x y"), (3, "")}
    assert remove_repeats(make([])).count() == 0


def test_sets_are_cut_by_shards_that_have_values():
    """At most one part a value, however many shards; the parts are those of floor(value * shards / 2**64)."""
    rng = np.random.default_rng(1)
    values = np.sort(np.concatenate([rng.integers(0, 1 << 64, 500, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)]))
    for shards in (1, 2, 3, 64, 1000, 390_625, (1 << 31) - 1):
        parts = list(split_by_shard(values, shards))
        assert len(parts) <= min(shards, len(values)) and [k for k, _ in parts] == sorted({int(v) * shards >> 64 for v in values})
        assert all(int(v) * shards >> 64 == k for k, part in parts for v in values[part])
    assert list(split_by_shard(values[:0], 64)) == []


def test_merged_sets_grow_with_values_not_with_pairs(spark):
    """300 blocks send 200 values each to 4096 shards: as rows of their own nearly one a value, merged far fewer."""
    rng = np.random.default_rng(2)
    shards, rows, direct, want = 4096, [], 0, set()
    for block in range(300):
        values = np.sort(rng.integers(0, 1 << 64, 200, dtype=np.uint64))
        direct += sum(1 for _ in split_by_shard(values, shards))
        want |= {(block, int(v)) for v in values}
        rows += [(k, block, 0, packed.pack_sorted(values[part]), None) for k, part in split_by_shard(values, packed.coarse(shards))]
    sent = spark.createDataFrame(rows, "shard int, block long, kind int, keys binary, more binary")
    found = packed.to_shards(sent, shards, limit=20_000).toArrow()
    assert direct > 50_000 and found.num_rows < direct / 3
    got = set()
    for i in range(found.num_rows):
        shard = found["shard"][i].as_py()
        for block, _, keys, _ in packed.sets_of(found.slice(i, 1)):
            assert all(int(v) * shards >> 64 == shard for v in keys) and (np.diff(keys) > 0).all()
            got |= {(block, int(v)) for v in keys}
    assert got == want
    told = spark.createDataFrame([(b, packed.pack_sorted(np.array([v], np.uint64)), None) for b, v in sorted(want)[:5000]], "block long, keys binary, more binary")
    back = packed.to_blocks(told, 17).toArrow().to_pylist()
    assert len(back) < 200 and {(r["block"], int(v)) for r in back for v in packed.unpack_sorted(r["keys"])} == set(sorted(want)[:5000])
