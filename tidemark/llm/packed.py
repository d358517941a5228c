"""Documents in compressed blocks, and sorted hash sets in compressed columns, so that joins move bytes instead of rows.

A block holds whole documents. What a block asks of, or tells, a hash shard is one packed set: sorted 64-bit values, as
differences split into byte planes. Work on a shard sees one set for each block, so a very common value costs one entry
a block and no shard depends on one key. Blocks and shards both grow with the table, within bounds that executors hold
(2 to 32 MB of text a block, 32 to 256 MB a shard).

A table of many blocks has many shards, and most pairs of them would share a few values only. Beyond MOST_SETS pairs sets
travel in two steps: to one of about the square root of the shards, where the sets of many blocks are merged (MERGED
values at a time, each with its block) and cut into the shards' own; answers go back to blocks the same way. The number of
rows then grows with the values, not with pairs of blocks and shards.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .tokens import pieces, text_buffer

BLOCK_BYTES, MOST_BLOCK_BYTES = 1 << 21, 1 << 25
SHARD_BYTES, MOST_SHARD_BYTES = 1 << 25, 1 << 28
#: Pairs of blocks and shards up to which each pair's set is a row of its own, and values merged at a time beyond.
MOST_SETS, MERGED = 1 << 28, 1 << 22
#: A document whose id is null: it sorts after every id.
NO_ID = np.iinfo(np.int64).max
BLOCK_SCHEMA = "block long, ids binary, nulls binary, offsets binary, body binary, n_bytes long"


def _z(raw: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def _unz(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def pack(values: np.ndarray) -> bytes:
    """Any fixed-width values, byte plane by byte plane."""
    width = values.dtype.itemsize
    return _z(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes())


def unpack(raw: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    planes = np.frombuffer(_unz(raw), np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit values."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)


def block_bytes(docs: DataFrame) -> int:
    """Text bytes of a block, from the planner's estimate of the table: some ten thousand blocks beyond 20 GB."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(min(MOST_BLOCK_BYTES, max(BLOCK_BYTES, size // 10_000)))


def blocks_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs' ids and texts as blocks in a table of the shared folder. A null text is an empty one."""
    limit = block_bytes(docs.select(text))
    cols = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch, "text", limit):
                buf, offsets = text_buffer(piece.column(1))
                ids = piece.column(0)
                row = [number, _z(ids.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()), _z(np.asarray(ids.is_null()).astype(np.uint8).tobytes()), pack(np.diff(offsets).astype(np.uint32)), _z(buf.tobytes(), 3), len(buf)]
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *[pa.array([x], pa.binary()) for x in row[1:5]], pa.array([row[5]], pa.int64())], names=["block", "ids", "nulls", "offsets", "body", "n_bytes"])

    return written(cols.mapInArrow(run, BLOCK_SCHEMA), "blocks")


def open_block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, which of them are null, text bytes and offsets of a block."""
    ids = np.frombuffer(_unz(row["ids"]), np.int64)
    nulls = np.frombuffer(_unz(row["nulls"]), np.uint8).astype(bool)
    offsets = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(unpack(row["offsets"], np.uint32).astype(np.int64), out=offsets[1:])
    return ids, nulls, np.frombuffer(_unz(row["body"]), np.uint8), offsets


def shard_count(blocks: DataFrame) -> int:
    """Shards for hashes of all words: so many that one holds the words of a bounded number of text bytes."""
    spark = blocks.sparkSession
    total = blocks.agg(F.sum("n_bytes")).head()[0] or 0
    each = min(MOST_SHARD_BYTES, max(SHARD_BYTES, total // 10_000))
    return max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 64, math.ceil(total / each))


def split_by_shard(values: np.ndarray, shards: int):
    """Sorted values cut where the shard of a value, floor(value * shards / 2**64), changes: the shards that have any, so
    there are never more parts than values, nor than shards."""
    high, low = values >> np.uint64(32), values & np.uint64(0xFFFFFFFF)
    shard = (high * np.uint64(shards) + (low * np.uint64(shards) >> np.uint64(32))) >> np.uint64(32)
    cuts = np.flatnonzero(np.concatenate([[len(values) > 0], shard[1:] != shard[:-1]])) if len(values) else np.zeros(0, np.int64)
    for lo, hi in zip(cuts, np.append(cuts[1:], len(values))):
        yield int(shard[lo]), slice(lo, hi)


def coarse(n: int) -> int:
    return max(1, math.isqrt(n))


_MERGED = "{key} long, blocks binary, kind int, keys binary, more binary"


def _gathered(batches, limit: int):
    """Runs of rows that hold about so many values together."""
    rows, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            row["keys"] = unpack_sorted(row["keys"])
            rows.append(row)
            size += len(row["keys"])
            if size >= limit:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _merged_rows(rows: list[dict], kind: int | None, more_kind):
    """Keys of the rows of one kind, with the block of each and what goes with it."""
    mine = [r for r in rows if r["kind"] == kind]
    blocks = [unpack(r["blocks"], np.int64) if r.get("blocks") is not None else np.full(len(r["keys"]), r["block"], np.int64) for r in mine]
    more = np.concatenate([unpack(r["more"], more_kind) for r in mine]) if mine and mine[0]["more"] is not None else None
    return np.concatenate([r["keys"] for r in mine]), np.concatenate(blocks), more


def _row(key: int, kind: int | None, blocks: np.ndarray | None, keys: np.ndarray, more: np.ndarray | None) -> tuple:
    return key, None if blocks is None else pack(blocks), kind, pack_sorted(keys), None if more is None else pack(more)


def _batch(rows: list[tuple], key: str) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 5, kinds)], names=[key, "blocks", "kind", "keys", "more"])


def to_shards(sent: DataFrame, shards: int, more_kind=None, limit: int | None = None) -> DataFrame:
    """(shard, blocks, kind, keys, more) for sets that were sent to coarse(shards) shards: those of many blocks in one."""
    limit = limit or MERGED

    def run(batches):
        for rows in _gathered(batches, limit):
            out = []
            for kind in sorted({r["kind"] for r in rows}):
                keys, blocks, more = _merged_rows(rows, kind, more_kind)
                order = np.argsort(keys, kind="stable")
                keys, blocks, more = keys[order], blocks[order], None if more is None else more[order]
                out += [_row(k, kind, blocks[part], keys[part], None if more is None else more[part]) for k, part in split_by_shard(keys, shards)]
            yield _batch(out, "shard")

    return sent.repartition("shard").mapInArrow(run, _MERGED.format(key="shard"))


def sets_of(rows: pa.Table, more_kind=None) -> list[tuple[int, int | None, np.ndarray, np.ndarray | None]]:
    """(block, kind, keys, more) of a shard's rows, whether a row is one block's set or those of many, merged."""
    out = []
    merged = rows["blocks"].to_pylist() if "blocks" in rows.column_names else itertools.repeat(None)
    single = rows["block"].to_pylist() if "block" in rows.column_names else itertools.repeat(None)
    for block, blocks, kind, keys, more in zip(single, merged, rows["kind"].to_pylist(), rows["keys"].to_pylist(), rows["more"].to_pylist()):
        keys, more = unpack_sorted(keys), None if more is None else unpack(more, more_kind)
        if blocks is None:
            out.append((block, kind, keys, more))
            continue
        blocks = unpack(blocks, np.int64)
        order = np.argsort(blocks, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], blocks[order][1:] != blocks[order][:-1], [True]])) if len(order) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            part = order[lo:hi]
            out.append((int(blocks[part[0]]), kind, keys[part], None if more is None else more[part]))
    return out


def to_blocks(told: DataFrame, groups: int, more_kind=None, limit: int | None = None) -> DataFrame:
    """(block, keys, more) for answers (block, keys, more) of many shards to many blocks: a block's, merged."""
    limit = limit or MERGED
    group = F.pmod(F.xxhash64("block"), F.lit(groups)).alias("group")

    def run(batches):
        for rows in _gathered(batches, limit):
            keys, blocks, more = _merged_rows(rows, None, more_kind)
            order = np.lexsort((keys, blocks))
            keys, blocks, more = keys[order], blocks[order], None if more is None else more[order]
            cuts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1], [True]]))
            yield _batch([_row(int(blocks[lo]), None, None, keys[lo:hi], None if more is None else more[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:])], "block")

    rows = told.select(group, "block", F.lit(None).cast("int").alias("kind"), "keys", "more").repartition("group").drop("group")
    return rows.mapInArrow(run, _MERGED.format(key="block")).select("block", "keys", "more")


def unique_min(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in order, the least id of each, and the greatest."""
    if not len(h):
        return h, ids, ids
    order = np.argsort(h)
    h, ids = h[order], ids[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[at], np.minimum.reduceat(ids, at), np.maximum.reduceat(ids, at)


def find(sorted_values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted value stands among sorted distinct values, and whether it is there."""
    if not len(sorted_values):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.searchsorted(sorted_values, wanted)
    at[at == len(sorted_values)] = 0
    return at, sorted_values[at] == wanted
