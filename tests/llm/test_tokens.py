import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.packed import pack_sorted, split_by_shard, unpack_sorted
from tidemark.llm.tokens import WORD, covered, span_hashes, text_buffer, window_starts, windows, words

texts = st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\v\f\rab\u00a0é😀\u0085", max_size=30)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_words_are_those_of_the_pattern(rows):
    buf, offsets = text_buffer(pa.array(rows, pa.string()))
    starts, ends, first = words(buf, offsets)
    raw = buf.tobytes()
    found = [[raw[starts[i] : ends[i]].decode() for i in range(first[k], first[k + 1])] for k in range(len(rows))]
    assert found == [re.findall(WORD, x or "") for x in rows]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab é", max_size=20), min_size=1, max_size=6), st.integers(1, 4))
def test_windows_hash_by_content(rows, size):
    buf, offsets = text_buffer(pa.array(rows, pa.string()))
    starts, ends, first = words(buf, offsets)
    h = span_hashes(buf, starts, ends)
    at, doc = window_starts(first, size)
    keys = [tuple(re.findall(WORD, rows[d])[a - first[d] : a - first[d] + size]) for a, d in zip(at, doc)]
    w = windows(h, size)[at] if len(at) else []
    assert len({(k, int(x)) for k, x in zip(keys, w)}) == len(set(keys)) == len({int(x) for x in w})


def test_covered_and_sliced_columns():
    assert covered(np.array([1, 2, 7]), 3, 9).tolist() == [False, True, True, True, True, False, False, True, True]
    whole = pa.array(["ab c", None, "de"]).slice(1)
    buf, offsets = text_buffer(whole)
    assert buf.tobytes() == b"de" and offsets.tolist() == [0, 0, 2]


def test_packed_sets_round_trip_and_split():
    v = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 5000, dtype=np.uint64))
    assert (unpack_sorted(pack_sorted(v)) == v).all()
    parts = list(split_by_shard(v, 7))
    assert (np.concatenate([v[p] for _, p in parts]) == v).all()
    assert all(int(x) * 7 >> 64 == k for k, p in parts for x in v[p][:5])
