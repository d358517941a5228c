"""Substring dedup by fixed-block anchors.

Blocks of ANCHOR = (window + 1) // 2 words at word offsets 0, ANCHOR, 2 * ANCHOR, ... of each document are indexed:
every window of the wanted length contains one whole. All rolling runs of ANCHOR words probe that index; a run found
elsewhere makes its surroundings candidates. Candidate windows alone are then compared at full length, by 128-bit
hashes, and runs of removable windows extend to maximal exact repeats.

A word goes if it lies in a window whose word sequence also starts in a document with a smaller id. Windows are judged
on the input. Three passes over the blocks; between them only packed hash sets move, and only for windows that repeat.

Defined cases: a null text has no words; a text shorter than the window loses none; no id is smaller
than a null one, nor a null one smaller than any, so such a document keeps all its words and takes none; rows with equal ids don't take words from each other; all rows
come back, extra columns don't; an empty table gives an empty result. A text is held whole by one task.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .packed import blocks_of, find, open_block, pack, pack_sorted, sets_of, shard_count, split_by_shard, unique_min, unpack, unpack_sorted
from .shared import freeing_shuffles, written
from .tokens import covered, per_text, span_hashes, window_starts, windows, words

WINDOW = 13


class _Words:
    """The words of a block, hashed."""

    def __init__(self, row: dict):
        self.ids, self.nulls, self.buf, self.offsets = open_block(row)
        self.starts, self.ends, self.first = words(self.buf, self.offsets)
        self.h = span_hashes(self.buf, self.starts, self.ends)

    def anchors(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions of all runs of so many words, their documents and hashes, and which runs are indexed blocks."""
        at, doc = window_starts(self.first, size)
        h = windows(self.h, size)
        return at, doc, h[at] if len(at) else np.zeros(0, np.uint64), (at - self.first[doc]) % size == 0


def _sends(shards: int, block: int, kinds: list) -> pa.RecordBatch | None:
    """Rows (shard, block, kind, keys, more) of packed sets; kinds: (kind, sorted keys, aligned values or None)."""
    rows = [(k, block, kind, pack_sorted(keys[part]), pack(more[part]) if more is not None else None) for kind, keys, more in kinds for k, part in split_by_shard(keys, shards)]
    if not rows:
        return None
    a, b, c, d, e = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(d, pa.binary()), pa.array(e, pa.binary())], names=["shard", "block", "kind", "keys", "more"])


_SENT = "shard int, block long, kind int, keys binary, more binary"
_TOLD = [("check", "<u8"), ("least", "<i8")]
_REPLY = "block long, keys binary, more binary"
INDEX, PROBE = 0, 1


def _live_anchors(rows: pa.Table) -> pa.Table:
    """For a shard: the indexed hashes that more than one block knows, told to every block that knows them."""
    block, kinds, sets, _ = zip(*sets_of(rows))
    indexed = [s for s, kind in zip(sets, kinds) if kind == INDEX]
    out: dict = defaultdict(list)
    if indexed:
        known, count = np.unique(np.concatenate(indexed), return_counts=True)
        for s, kind in zip(sets, kinds):
            if kind == PROBE:
                at, there = find(known, s)
                count[at[there]] += 1
        live = known[count > 1]
        for s, b in zip(sets, block):
            if len(hit := s[find(live, s)[1]]):
                out[b].append(hit)
    return _replies({b: (np.sort(np.concatenate(x)), None) for b, x in out.items()})


def _least_ids(rows: pa.Table) -> pa.Table:
    """For a shard: the least id of each window, told to the blocks that know only greater ones."""
    block, _, keys, more = zip(*sets_of(rows, _TOLD))
    out = {}
    if keys:
        h, check = np.concatenate(keys), np.concatenate([m["check"] for m in more])
        least = np.concatenate([m["least"] for m in more])
        order = np.lexsort((check, h))
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])
        group = np.cumsum(new) - 1
        lowest = np.full(group[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(lowest, group, least[order])
        best = np.empty(len(h), np.int64)
        best[order] = lowest[group]
        at = 0
        for b, k, m in zip(block, keys, more):
            mine = best[at : at + len(k)]
            at += len(k)
            if (hit := mine < m["least"]).any():
                # Keys may repeat with another check value; the block tells them apart by the check.
                told = np.zeros(int(hit.sum()), _TOLD)
                told["check"], told["least"] = m["check"][hit], mine[hit]
                out.setdefault(b, []).append((k[hit], told))
    return _replies({b: _joined(x) for b, x in out.items()})


def _joined(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """A block's answers from sets that came apart, as one sorted set."""
    keys, more = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(keys, kind="stable")
    return keys[order], more[order]


def _replies(found: dict) -> pa.Table:
    return pa.table({"block": pa.array(list(found), pa.int64()), "keys": pa.array([pack_sorted(k) for k, _ in found.values()], pa.binary()), "more": pa.array([None if m is None else pack(m) for _, m in found.values()], pa.binary())})


def _ask(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """Each block with the sets that shards told it, at most one for each shard."""
    told = replies.groupBy("block").agg(F.collect_list(F.struct("keys", "more")).alias("told"))
    return blocks.join(told, "block", "left")


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _sorted_told(row: dict, kind=None) -> tuple[np.ndarray, np.ndarray | None]:
    told = row["told"] or []
    keys = [unpack_sorted(x["keys"]) for x in told]
    keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    order = np.argsort(keys, kind="stable")
    if kind is None:
        return keys[order], None
    more = [unpack(x["more"], kind) for x in told]
    more = np.concatenate(more) if more else np.zeros(0, kind)
    return keys[order], more[order]


def _candidates(w: _Words, row: dict, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and documents of the windows that hold an anchor known elsewhere."""
    at, doc, h, own = w.anchors(anchor)
    if not len(at):
        return at, doc
    live = np.unique(_sorted_told(row)[0])
    hit = find(live, h)[1]
    # An indexed block may repeat within this block alone; shards can't see that.
    known, least, most = unique_min(h[own], w.ids[doc[own]])
    place, there = find(known, h)
    ids = w.ids[doc]
    twice = np.zeros(len(known), dtype=bool)
    np.logical_or.at(twice, place[there], (ids[there] != least[place[there]]) | (least[place[there]] != most[place[there]]))
    hit |= there & twice[place] if len(known) else False
    marked = np.zeros(len(w.h) + 1, np.int64)
    marked[at[hit] + 1] = 1
    total = np.cumsum(marked)
    start, of = window_starts(w.first, window)
    # A window that starts at s holds the anchors that start at s .. s + window - anchor.
    some = total[start + window - anchor + 1] > total[start]
    return start[some], of[some]


def _own_windows(w: _Words, start: np.ndarray, doc: np.ndarray, window: int):
    """Hash, check and id of the windows at these starts, and of each distinct window the least id."""
    h = windows(w.h, window)[start] if len(start) else np.zeros(0, np.uint64)
    check = windows(w.h, window, 1)[start] if len(start) else np.zeros(0, np.uint64)
    ids = w.ids[doc] if len(start) else np.zeros(0, np.int64)
    order = np.lexsort((check, h))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])
    first = np.flatnonzero(new)
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(ids[order], first) if len(h) else ids
    return h[order][first], check[order][first], least, group, ids


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the words that stay, joined by one space."""
    spark, anchor = docs.sparkSession, (window + 1) // 2
    blocks = blocks_of(docs, doc_id, text)
    shards, n_blocks = shard_count(blocks), blocks.count()
    # Beyond so many pairs of blocks and shards sets are merged on their way.
    two_steps = n_blocks * shards > packed.MOST_SETS
    first_shards = packed.coarse(shards) if two_steps else shards

    def exchanged(sent: DataFrame, work, more_kind=None) -> DataFrame:
        if not two_steps:
            return sent.groupBy("shard").applyInArrow(work, _REPLY)
        told = packed.to_shards(sent, shards, more_kind).groupBy("shard").applyInArrow(work, _REPLY)
        return packed.to_blocks(told, packed.coarse(n_blocks), more_kind)

    def anchors(batches):
        for row in _rows(batches):
            _, _, h, own = _Words(row).anchors(anchor)
            mine = np.unique(h[own])
            rest = np.unique(h[~own])
            if (sent := _sends(first_shards, row["block"], [(INDEX, mine, None), (PROBE, rest[~find(mine, rest)[1]], None)])) is not None:
                yield sent

    def candidates(batches):
        for row in _rows(batches):
            w = _Words(row)
            h, check, least, _, _ = _own_windows(w, *_candidates(w, row, window, anchor), window)
            more = np.zeros(len(h), _TOLD)
            more["check"], more["least"] = check, least
            if (sent := _sends(first_shards, row["block"], [(0, h, more)])) is not None:
                yield sent

    def clean(batches):
        for row in _rows(batches):
            w = _Words(row)
            start, doc = _candidates(w, row | {"told": row["live"]}, window, anchor)
            h, check, least, group, ids = _own_windows(w, start, doc, window)
            keys, more = _sorted_told(row, _TOLD)
            least = least.copy()
            # Distinct windows of a block have distinct (hash, check); equal hashes with other checks stand side by side.
            for k in range(_longest_run(keys)):
                at = np.searchsorted(keys, h) + k
                inside = at < len(keys)
                hit = np.flatnonzero(inside)[(keys[at[inside]] == h[inside]) & (more["check"][at[inside]] == check[inside])]
                least[hit] = np.minimum(least[hit], more["least"][at[hit]])
            gone = covered(start[(least[group] < ids) & ~w.nulls[doc]], window, len(w.h))
            yield _kept(w, gone)

    with freeing_shuffles(spark):
        live = exchanged(blocks.mapInArrow(anchors, _SENT), _live_anchors)
        asked = written(_ask(blocks.select("block"), live).select("block", F.col("told").alias("live")), "anchors")
        first = blocks.join(asked, "block").withColumn("told", F.col("live"))
        least = exchanged(first.mapInArrow(candidates, _SENT), _least_ids, _TOLD)
        least = written(least, "windows")
    told = least.groupBy("block").agg(F.collect_list(F.struct("keys", "more")).alias("told"))
    last = blocks.join(asked, "block").join(told, "block", "left")
    return last.mapInArrow(clean, "id long, n_words long, n_removed long, kept string").withColumnRenamed("id", doc_id)


def _longest_run(keys: np.ndarray) -> int:
    if not len(keys):
        return 0
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    return int(np.diff(edges).max())


def _kept(w: _Words, gone: np.ndarray) -> pa.RecordBatch:
    n, removed = np.diff(w.first), per_text(gone.astype(np.int64), w.first)
    stay = ~gone
    # Bytes of kept words, each but a text's first after one space.
    begin, end = w.starts[stay], w.ends[stay]
    count = np.zeros(len(w.first), np.int64)
    np.cumsum(n - removed, out=count[1:])
    length = end - begin
    lead = np.ones(len(begin), np.int64)
    lead[count[:-1][np.diff(count) > 0]] = 0
    where = np.cumsum(length + lead) - length
    out = np.full(int((length + lead).sum()), 32, np.uint8)
    mark = np.zeros(len(w.buf) + 1, np.int8)
    mark[begin] = 1
    np.subtract.at(mark, end, 1)
    inside = np.cumsum(mark[:-1]).astype(bool)
    put = np.zeros(len(out) + 1, np.int8)
    put[where] = 1
    np.subtract.at(put, where + length, 1)
    out[np.cumsum(put[:-1]).astype(bool)] = w.buf[inside]
    size = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(length + lead, out=size[1:])
    texts = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(size[count].tobytes()), pa.py_buffer(out.tobytes())).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(w.ids, mask=w.nulls), pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)), texts], names=["id", "n_words", "n_removed", "kept"])
