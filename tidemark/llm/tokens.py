"""Words of whole Arrow columns as numpy arrays: boundaries, hashes and windows, without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: The six characters that part words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\v\f\r"
#: Text bytes of a piece whose running sums and hashes take some 100 bytes a text byte while it is worked on.
PIECE = 1 << 18

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd multipliers of the two polynomial hashes modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict = {}


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, name: str, limit: int = 1 << 20):
    """The batch in runs of rows of about so many text bytes; a longer text is a run of its own."""
    lengths = np.diff(text_buffer(batch.column(name))[1])
    at = 0
    while at < len(lengths):
        total = np.cumsum(lengths[at : at + 20_000])
        n = max(1, int(np.searchsorted(total, limit, side="right")))
        yield batch.slice(at, n)
        at += n


def words(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each text the index of its first word (n + 1 values); space flags the bytes between words."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~space[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(buf), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(buf), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    key = base
    if key not in _POWERS or len(_POWERS[key][0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[key] = tuple(both)
    up, down = _POWERS[key]
    return up[:n], down[:n]


def running_hash(buf: np.ndarray, which: int = 0) -> np.ndarray:
    """What span_hashes takes differences of: one value more than there are bytes."""
    n = len(buf)
    up, _ = _powers(_BASES[which], n + 1)
    total = np.zeros(n + 1, np.uint64)
    value = buf.astype(np.uint64)
    value += np.uint64(1)
    value *= up[:n]
    np.cumsum(value, out=total[1:])
    return total


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0, total: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each byte span; the same bytes give the same value wherever they stand. total: running_hash(buf, which)."""
    total = running_hash(buf, which) if total is None else total
    _, down = _powers(_BASES[which], len(buf) + 1)
    h = (total[ends] - total[starts]) * down[starts]
    return _mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


def windows(h: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of each run of so many consecutive values, len(h) - size + 1 of them; none if there are fewer values."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    base, factor = _BASES[which] | 1, 1
    for k in range(size):
        out += h[k : k + n] * np.uint64(factor)
        factor = factor * base % (1 << 64)
    return _mix(out)


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window lies within one text, and the text of each; first has each text's first word."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return np.arange(len(doc)) - np.repeat(begin - first[:-1], counts), doc


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """True for each of n positions that lies within size positions from one of the starts."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.subtract.at(step, np.minimum(starts + size, n), 1)
    return np.cumsum(step[:n]) > 0


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each text's words."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
