"""Importance resampling towards a target distribution over hashed n-grams.

Words of a text are lower-cased (A-Z only) runs of ASCII letters, digits and characters beyond ASCII. Its features are all
runs of 1 to N consecutive words, joined by a space, repeats counted; each falls into the bucket of its CRC-32. Buckets
counted over all documents and over all target texts give each bucket its gain: the log ratio of smoothed target and
source shares, in thousandths, rounded down. A document's weight is the sum of the gains of its features. With Gumbel noise
from a hash of its key added, the highest scores are a sample without replacement that leans towards the target.

Texts are cut in chunks at word boundaries. A chunk owns the features that start in its words and carries the N - 1 words
after them, so every feature is counted once, wherever the cuts fall. Texts beyond CHUNK bytes become rows of chunks, dealt
to all tasks whatever text they come from; counts and weights of chunks are summed by document. Shorter texts are one chunk
and go where they are read. Bucket counts are summed in each task before they travel; the gains, one number a bucket, are
what goes to every task. Ranks come from an ordered scan, so no task holds all scores.

Defined cases: a null or empty text has no features and weight 0; a null key counts as an empty string in the noise and
stands first among ties; equal rows are drawn apart; ties of score and key go by n_features, weight and words; an empty
table gives an empty result, an empty target gives gains from smoothing alone. Columns named like the results are replaced.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import numbered
from .arrow import each_piece
from .shared import written
from .tokens import per_text, text_buffer, words

BUCKETS = 10_000
N = 3
CHUNK = 1 << 16
SEED = 42
MIN_WORDS = 20
#: Chunks that are cut at a time.
CHUNKS = 64
#: Words of more bytes are hashed one by one.
LONG = 64
COUNTS = ("n_words", "n_features", "weight")
RESULTS = (*COUNTS, "score", "rank")

#: Bytes between words: ASCII but for digits and letters.
_APART = np.zeros(256, dtype=bool)
_APART[:128] = True
for _span in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    _APART[_span[0] : _span[1] + 1] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@cache
def _crc_byte() -> np.ndarray:
    """CRC-32 register after one byte, by its lowest byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


@cache
def _crc_shift() -> np.ndarray:
    """[l, k, b]: what byte k of value b in a register becomes after l zero bytes, for l up to LONG + 1."""
    one, out = _crc_byte(), np.zeros((LONG + 2, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << (8 * k)
    for n in range(1, LONG + 2):
        out[n] = one[out[n - 1] & 255] ^ (out[n - 1] >> 8)
    return out.reshape(-1)


def _after(crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The part of a CRC that stays from what stands so many bytes before the end."""
    table, out, left = _crc_shift(), crc, sizes
    while True:
        now = np.minimum(left, LONG + 1)
        at = now * 1024
        out = table[at + (out & 255)] ^ table[at + 256 + ((out >> 8) & 255)] ^ table[at + 512 + ((out >> 16) & 255)] ^ table[at + 768 + (out >> 24)]
        left = left - now
        if not left.any():
            return out


def word_crcs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte span: one step for each byte of the longest of the short ones, over all that reach it."""
    sizes, table = ends - starts, _crc_byte()
    out = np.zeros(len(starts), np.uint32)
    short = np.flatnonzero(sizes <= LONG)
    short = short[np.argsort(-sizes[short], kind="stable")]
    at, reg = starts[short], np.full(len(short), 0xFFFFFFFF, np.uint32)
    for k, m in enumerate(np.searchsorted(-sizes[short], -np.arange(1, LONG + 1), side="right")):
        if not m:
            break
        reg[:m] = table[(reg[:m] ^ buf[at[:m] + k]) & 255] ^ (reg[:m] >> 8)
    out[short] = reg ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > LONG):
        out[i] = zlib.crc32(buf[starts[i] : ends[i]].tobytes())
    return out


def features(buf: np.ndarray, offsets: np.ndarray, own: np.ndarray | None = None, n: int = N) -> tuple[list[np.ndarray], np.ndarray]:
    """CRCs of the runs of 1 .. n words, by the word they start at, as n arrays (each with a mask of real ones), and
    each text's first word (one value more than texts). own: how many words of each text own features; the rest is carry."""
    buf = _LOWER[buf]
    starts, ends, first = words(buf, offsets, _APART)
    crc, size = word_crcs(buf, starts, ends), ends - starts
    space = np.uint32(zlib.crc32(b" "))
    spaced = _after(np.full(len(crc), space, np.uint32), size) ^ crc
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    left = first[1:][doc] - np.arange(len(crc))  # words from here to the text's end
    mine = np.ones(len(crc), bool) if own is None else np.arange(len(crc)) - first[:-1][doc] < own[doc]
    out, run = [], crc
    for k in range(n):
        if k:
            run = run[:-1] if len(run) else run
            run = _after(run, size[k:] + 1) ^ spaced[k:] if len(run) else run
        out.append((run, mine[: len(run)] & (left[: len(run)] > k)))
    return out, first


def _counted(texts: DataFrame, buckets: int, n: int) -> DataFrame:
    """(bucket, n) over rows of (text, own): each task sums its own first."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for piece in each_piece(batches, "text"):
            own = piece.column(piece.schema.get_field_index("own")).to_numpy(zero_copy_only=False)
            for crc, real in features(*text_buffer(piece.column(piece.schema.get_field_index("text"))), own, n)[0]:
                total += np.bincount(crc[real] % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _cut(chunk: int, n: int):
    """Rows (row, text) to rows (row, part, text, own): pieces of about so many bytes that begin and end at words."""

    def run(batches):
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode()
                buf = np.frombuffer(raw, np.uint8)
                starts, ends, _ = words(buf, np.array([0, len(buf)]), _APART)
                cuts = np.append(np.flatnonzero(np.diff(starts // chunk, prepend=-1)), len(starts))
                for at in range(0, len(cuts) - 1, CHUNKS):
                    edges = cuts[at : at + CHUNKS + 1]
                    texts = [raw[starts[a] : ends[min(b + n - 2, len(ends) - 1)]].decode() for a, b in zip(edges[:-1], edges[1:])]
                    parts = np.arange(at, at + len(texts))
                    columns = [np.full(len(texts), k), parts, pa.array(texts), np.diff(edges)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["_row", "part", "text", "own"])

    return run


_OWN_ALL = (1 << 62) - 1


class Corpus:
    """Documents as chunks: texts up to CHUNK bytes in place, longer ones as rows of a table of their own."""

    def __init__(self, docs: DataFrame, text: str, chunk: int, n: int):
        size = F.coalesce(F.octet_length(text), F.lit(0))
        self.short, long = docs.where(size <= chunk), docs.where(size > chunk)
        self.text, self.n = text, n
        # Rows of their own number: other columns stay behind and are met again by it.
        self.long = written(long.withColumn("_row", F.monotonically_increasing_id()), "long-texts")
        parts = self.long.select("_row", F.col(text).alias("text")).mapInArrow(_cut(chunk, n), "_row long, part long, text string, own long")
        self.chunks = written(parts.repartition("_row", "part"), "chunks")

    def counts(self, buckets: int) -> DataFrame:
        whole = self.short.select(F.col(self.text).alias("text"), F.lit(_OWN_ALL).alias("own"))
        return _counted(whole, buckets, self.n).unionByName(_counted(self.chunks.select("text", "own"), buckets, self.n)).groupBy("bucket").agg(F.sum("n").alias("n"))

    def weighed(self, gains: np.ndarray, keep: list[str]) -> DataFrame:
        """keep, n_words, n_features and weight of every document."""
        n = self.n

        def run(batches):
            for piece in each_piece(batches, "_text"):
                at = piece.schema.get_field_index
                own = piece.column(at("_own")).to_numpy(zero_copy_only=False)
                found, first = features(*text_buffer(piece.column(at("_text"))), own, n)
                m = int(first[-1])
                count, weight = np.zeros(m, np.int64), np.zeros(m, np.int64)
                for crc, real in found:
                    count[: len(crc)] += real
                    weight[: len(crc)] += np.where(real, gains[crc % np.uint32(len(gains))], 0)
                sums = [per_text(x, first) for x in (count, weight)]
                rest = [c for c in piece.schema.names if c not in ("_text", "_own")]
                n_words = np.minimum(np.diff(first), own)
                yield pa.RecordBatch.from_arrays([*[piece.column(at(c)) for c in rest], *map(pa.array, (n_words, *sums))], names=[*rest, "n_words", "n_features", "weight"])

        def rows(df: DataFrame, rest: list[str], text: str, own) -> DataFrame:
            kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema.fields)
            return df.select(*rest, F.col(text).alias("_text"), own.alias("_own")).mapInArrow(run, f"{kinds}, n_words long, n_features long, weight long")

        short = rows(self.short, keep, self.text, F.lit(_OWN_ALL))
        parts = rows(self.chunks, ["_row"], "text", F.col("own"))
        sums = parts.groupBy("_row").agg(*[F.sum(c).alias(c) for c in COUNTS])
        long = self.long.select(*keep, "_row").join(sums, "_row", "left")
        return short.unionByName(long.select(*keep, *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS]))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, from (bucket, n) of both sides: one number a bucket."""
    both = source.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full")
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in both.collect():  # at most one row a bucket
        s[r["bucket"]], t[r["bucket"]] = r["s"] or 0, r["t"] or 0
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", share: tuple[int, int] = (5, 100), min_words: int = MIN_WORDS, buckets: int = BUCKETS, n: int = N, chunk: int = CHUNK, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, n_words, n_features, weight, score, rank) of every document; rank is null where it is not drawn.

    share: the part of the documents of min_words words at least that is drawn, as a fraction, rounded down."""
    corpus, wanted = Corpus(docs, text, chunk, n), Corpus(target, target_text, chunk, n)
    kept = [key, *[c for c in keep if c.lower() not in (key.lower(), *RESULTS)]]
    found = corpus.weighed(gains(corpus.counts(buckets), wanted.counts(buckets), buckets), kept)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(found.withColumn("score", (F.col("weight") + noise).cast("long")), "scores")
    able = F.col("n_words") >= min_words
    drawn = scored.where(able).count() * share[0] // share[1]
    order = [F.col("score").desc(), F.col(key).asc(), F.col("n_features").asc(), F.col("weight").asc(), F.col("n_words").asc()]
    ranked = numbered(scored.where(able), order, (), "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
