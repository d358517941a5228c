"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents are sets of SHINGLE-word n-grams. Equal sets form one copy class, which then stands for its documents.
MinHash bands (BANDS of BAND_ROWS values: a pair at the threshold shares none with probability (1 - 0.8**4)**32, about
5e-8) link classes into candidate clusters. Within a cluster pairs compare MinHash values STEP at a time and drop out
as soon as the posterior probability of reaching the threshold, given a uniform prior, falls below TOLERANCE; all
others are verified exactly on their n-gram sets. Links are counted with the sizes of the classes they join, and
connected components of links are the similarity classes.

Clusters of more than WIDE classes, which a passage shared by many documents makes, are cut by an exact prefix filter:
all n-grams are put in one order, those of rare buckets first (BUCKETS counts of the classes that hold an n-gram that
hashes there), and two sets can reach the threshold only if the least n-gram they share is among the first
n - ceil(threshold * n) + 1 of both. Classes that share none of these are no candidates, so text that many documents
share makes candidates only where it is nearly all of them. Any common order is exact; counts make it selective.

A cluster of more than SIDE classes is compared in pairs of blocks, one group each; what a group returns is one count
and one link for each member, never its pairs. Small clusters share groups. A very common n-gram or band costs one row
a class.

Defined cases: a text of 1 to SHINGLE - 1 words is one n-gram of all its words; one without words, or null, is similar
to none; rows with a null id take no part and come back with a null class and no links; rows with equal ids are
different documents; class_id is the least id of the class; an empty table gives an empty result; other columns are
not read. A text is held whole by one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import each_piece
from .graph import components
from .packed import pack_sorted, unpack_sorted
from .shared import small, small_batches, written
from .tokens import PIECE, _mix, span_hashes, text_buffer, window_starts, windows, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 32, 4
STEP = 32
TOLERANCE = 1e-6
SIDE = 1024
#: Classes beyond which a cluster is cut by the prefix filter, and the most counts that order its n-grams.
WIDE, BUCKETS = 64, 1 << 22
#: Classes of a band that one task links; a band with more is dealt to several.
BAND_PART = 512
#: Texts fetched by a broadcast of one long for each.
MAX_FETCHED = 2_000_000
BIN = 2000
_SEED = 20_011


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text, in order: values, text offsets, words of each text."""
    buf, offsets = text_buffer(column)
    starts, ends, first = words(buf, offsets)
    h, n = span_hashes(buf, starts, ends), np.diff(first)
    at, doc = window_starts(first, size)
    found, of = [windows(h, size)[at]] if len(at) else [np.zeros(0, np.uint64)], [doc]
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        if len(short):
            found.append(windows(h, k)[first[short]] + np.uint64(k))
            of.append(short)
    value, of = np.concatenate(found), np.concatenate(of)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[new], of[new]
    return value, np.searchsorted(of, np.arange(len(n) + 1)), n


def _multipliers() -> np.ndarray:
    return np.random.default_rng(_SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values (texts x BANDS * BAND_ROWS, 32 bits) of texts that have n-grams."""
    out = np.empty((len(offsets) - 1, BANDS * BAND_ROWS), np.uint32)
    for k, a in enumerate(_multipliers()):
        mixed = (value ^ (value >> np.uint64(29))) * a
        out[:, k] = np.minimum.reduceat((mixed >> np.uint64(32)).astype(np.uint32), offsets[:-1])
    return out


def set_key(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit value for each set, the same for equal sets."""
    both = _mix(value ^ np.uint64(0x5851F42D4C957F2D))
    total = np.add.reduceat(both, offsets[:-1]) + np.diff(offsets).astype(np.uint64) * np.uint64(0x14057B7EF767814F)
    return _mix(total).view(np.int64)


_FEATURES = "doc_id long, text_hash long, key long, n_shingles int, sig binary"


def _features(batches):
    for piece in each_piece(batches, "text", PIECE):
        value, offsets, _ = shingles(piece.column(2))
        some = np.flatnonzero(np.diff(offsets) > 0)
        n = piece.num_rows
        key, size, sig = np.zeros(n, np.int64), np.diff(offsets), [None] * n
        if len(some):
            edges = np.append(offsets[some], offsets[-1])
            key[some] = set_key(value, edges)
            for i, s in zip(some, signatures(value, edges)):
                sig[i] = s.tobytes()
        yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(key, mask=size == 0), pa.array(size.astype(np.int32)), pa.array(sig, pa.binary())], names=["doc_id", "text_hash", "key", "n_shingles", "sig"])


def _bands(batches):
    """(band, key): a hash of each band's values, with the band's number in it."""
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(key), BANDS, BAND_ROWS).astype(np.uint64)
        h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15), sig.shape[:2]).copy()
        for k in range(BAND_ROWS):
            h = _mix((h ^ sig[:, :, k]) * np.uint64(0xD6E8FEB86659FD93))
        yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(np.repeat(key, BANDS))], names=["band", "key"])


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(n, m): of n MinHash values so many must agree, else P(J >= threshold | agreement) < tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """
    out = []
    for n in range(STEP, BANDS * BAND_ROWS + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _agreeing(a: np.ndarray, b: np.ndarray, same: bool, table: list) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that no pruning step drops: positions in a and b; with same, each pair of one block once."""
    left, right = [], []
    n, m = table[0]
    for i in range(0, len(a), 64):
        part = a[i : i + 64]
        agree = np.zeros((len(part), len(b)), np.uint8)
        for k in range(n):
            agree += part[:, k, None] == b[None, :, k]
        x, y = np.nonzero(agree >= m)
        keep = (x + i < y) if same else np.ones(len(x), dtype=bool)
        x, y = x[keep] + i, y[keep]
        count = agree[x - i, y].astype(np.int32)
        for before, (n2, m2) in zip(table, table[1:]):
            if not len(x):
                break
            count += (a[x, before[0] : n2] == b[y, before[0] : n2]).sum(1)
            keep = count >= m2
            x, y, count = x[keep], y[keep], count[keep]
        left.append(x)
        right.append(y)
    return np.concatenate(left) if left else np.zeros(0, np.int64), np.concatenate(right) if right else np.zeros(0, np.int64)


def _shared(sets_a: list, sets_b: list, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The exact number of n-grams that the sets of each pair share."""
    if len(x) < 2000:
        return np.array([len(np.intersect1d(sets_a[i], sets_b[j], assume_unique=True)) for i, j in zip(x, y)], np.int64)
    # Many pairs: a 0/1 matrix of the n-grams that both sides hold, some columns at a time.
    rows, cols = np.unique(x), np.unique(y)
    va, vb = np.concatenate([sets_a[i] for i in rows]), np.concatenate([sets_b[j] for j in cols])
    both = np.intersect1d(va, vb)
    ra, rb = np.repeat(np.arange(len(rows)), [len(sets_a[i]) for i in rows]), np.repeat(np.arange(len(cols)), [len(sets_b[j]) for j in cols])
    px, py = np.searchsorted(rows, x), np.searchsorted(cols, y)
    out = np.zeros(len(x), np.int64)
    for at in range(0, len(both), 4096):
        part = both[at : at + 4096]

        def matrix(values, of, n):
            place = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[place] == values
            m = np.zeros((n, len(part)), np.float32)
            m[of[hit], place[hit]] = 1
            return m

        out += (matrix(va, ra, len(rows)) @ matrix(vb, rb, len(cols)).T)[px, py].astype(np.int64)
    return out


def _reaches(shared: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: float) -> np.ndarray:
    return shared >= threshold * (size_a + size_b - shared) - 1e-9


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n members the first of its local component."""
    up = np.arange(n)

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in zip(x.tolist(), y.tolist()):
        a, b = top(i), top(j)
        if a != b:
            up[max(a, b)] = min(a, b)
    return np.array([top(i) for i in range(n)], np.int64)


def _compare(key: np.ndarray, weight: np.ndarray, sig: np.ndarray, sets: list, first: np.ndarray, same: bool, table: list, threshold: float):
    """Members of one cluster's block (same) or of two (first flags the first): links of each, and its local root."""
    a = np.arange(len(key)) if same else np.flatnonzero(first)
    b = a if same else np.flatnonzero(~first)
    x, y = _agreeing(sig[a], sig[b], same, table)
    x, y = a[x], b[y]
    if len(x):
        size = np.array([len(s) for s in sets])
        ok = _reaches(_shared(sets, sets, x, y), size[x], size[y], threshold)
        x, y = x[ok], y[ok]
    links = np.bincount(x, weight[y], len(key)) + np.bincount(y, weight[x], len(key))
    return links.astype(np.int64), _roots(len(key), x, y)


def _group(threshold: float, tolerance: float):
    table = least_matches(threshold, tolerance)

    def run(rows: pa.Table) -> pa.Table:
        cluster, key = rows["cluster"].to_numpy(), rows["key"].to_numpy()
        weight, side = rows["weight"].to_numpy(), rows["side"].to_numpy()
        same = rows["i"].to_numpy() == rows["j"].to_numpy()
        order = np.lexsort((key, cluster))
        cut = np.flatnonzero(np.concatenate([[True], cluster[order][1:] != cluster[order][:-1], [True]]))
        sig, grams = rows["sig"].to_pylist(), rows["grams"].to_pylist()
        out: list = []
        for lo, hi in zip(cut[:-1], cut[1:]):
            part = order[lo:hi]
            values = np.stack([np.frombuffer(sig[i], np.uint32) for i in part])
            links, root = _compare(key[part], weight[part], values, [unpack_sorted(grams[i]) for i in part], side[part] == 0, bool(same[part[0]]), table, threshold)
            out.append((key[part], links, key[part][root]))
        k, n, r = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"key": pa.array(k), "links": pa.array(n), "root": pa.array(r)})

    return run


def _grams(batches):
    """(key, grams): the packed n-grams of texts."""
    for piece in each_piece(batches, "text", PIECE):
        value, offsets, _ = shingles(piece.column(0))
        some = np.flatnonzero(np.diff(offsets) > 0)
        key = set_key(value, np.append(offsets[some], offsets[-1])) if len(some) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array([pack_sorted(value[offsets[i] : offsets[i + 1]]) for i in some], pa.binary())], names=["key", "grams"])


def _linked(bands: DataFrame, shared: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the classes of each band: to the band's least, or in a common band to the least of a
    part, which links to the band's least."""
    crowded = shared.where(F.col("n") > BAND_PART).select("band", F.ceil(F.sqrt(F.col("n") / F.lit(BAND_PART)) * 8).cast("int").alias("parts"))
    plain = shared.where(F.col("n") <= BAND_PART)
    edge = lambda rows, head: rows.where(F.col("key") != F.col(head)).select(F.col("key").alias("a"), F.col(head).alias("b"))
    near = edge(bands.join(plain, "band"), "head")
    if crowded.isEmpty():
        return near
    common = bands.join(small(crowded), "band").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    heads = written(common.groupBy("band", "part").agg(F.min("key").alias("own")), "heads")
    inner = edge(common.join(heads, ["band", "part"]), "own")
    outer = edge(heads.withColumnRenamed("own", "key").join(shared.select("band", "head"), "band"), "head")
    return near.union(inner).union(outer)


def _fetched(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(key, grams) of the classes of members, from the text that stands for each.

    So few texts are fetched by a broadcast of a hash of their ids, and none is shuffled; more by a shuffle, which the
    planner thins by a Bloom filter where it can. A text fetched by a collision finds no member later.
    """
    wanted = small(members.select(F.xxhash64("least.doc_id", "least.text_hash").alias("wanted")).distinct(), MAX_FETCHED)
    found = texts.join(wanted, F.xxhash64("doc_id", "text_hash") == F.col("wanted"), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return found.select("text").mapInArrow(_grams, "key long, grams binary").dropDuplicates(["key"])


def _bucket(value: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(value ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(buckets - 1)).astype(np.int64)


def first_grams(value: np.ndarray, level: np.ndarray, offsets: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each set the n-grams that a set reaching the threshold with it must share one of: values, and their sets."""
    size = np.diff(offsets)
    of = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((value, level, of))
    most = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
    take = order[np.arange(len(value)) - offsets[of] < most[of]]
    return value[take], of[take]


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    sets = [unpack_sorted(g) for g in batch.column("grams").to_pylist()]
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def _narrowed(clusters: DataFrame, classes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """clusters (key, cluster) with those of more than WIDE classes cut into candidates of the prefix filter."""
    crowded = small(clusters.groupBy("cluster").count().where(F.col("count") > WIDE).select("cluster"))
    if crowded.isEmpty():
        return clusters
    wide = written(clusters.join(crowded, "cluster", "left_semi").join(classes, "key").select("key", "least"), "wide")
    grams = written(_fetched(texts, wide).join(wide.select("key"), "key", "left_semi"), "wide-grams")
    buckets = 1 << min(BUCKETS.bit_length() - 1, max(16, (64 * wide.count()).bit_length()))

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                total += np.bincount(_bucket(_unpacked(batch.slice(at, 256))[0], buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    # At most BUCKETS numbers, however large the table.
    held = grams.select("grams").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.floor(8 * F.log2(F.sum("n"))).cast("short").alias("level")).toArrow()
    levels = np.zeros(buckets, np.int16)
    levels[held["bucket"].to_numpy()] = held["level"].to_numpy()
    shipped = texts.sparkSession.sparkContext.broadcast(levels)

    def first(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                value, offsets = _unpacked(piece)
                gram, of = first_grams(value, shipped.value[_bucket(value, buckets)], offsets, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), piece.column("key").take(pa.array(of))], names=["band", "key"])

    firsts = written(grams.select("key", "grams").mapInArrow(first, "band long, key long"), "first-grams")
    shared = firsts.groupBy("band").agg(F.min("key").alias("head"), F.count("*").alias("n")).where("n > 1")
    cut = components(_linked(firsts, written(shared, "first-shared"))).withColumnsRenamed({"node": "key", "root": "cluster"})
    return clusters.join(crowded, "cluster", "left_anti").select("key", "cluster").unionByName(cut)


def candidates(texts: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(key, cluster): classes that may reach the threshold with another of their cluster."""
    bands = classes.select("key", "sig").mapInArrow(_bands, "band long, key long")
    shared = bands.groupBy("band").agg(F.min("key").alias("head"), F.count("*").alias("n")).where("n > 1")
    clusters = written(components(_linked(bands, written(shared, "bands"))).withColumnsRenamed({"node": "key", "root": "cluster"}), "clusters")
    return written(_narrowed(clusters, classes, texts, threshold), "candidates")


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, text_hash, class_id, copy_of, n_links) for each row: the similarity class, the least id with an equal
    n-gram set, and how many other documents reach the threshold, copies included."""
    return _similar(docs, doc_id, text, threshold, tolerance).drop("root")


def _similar(docs: DataFrame, doc_id: str, text: str, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """similar() with root, which tells classes apart whose least ids are equal."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    rows = written(texts.mapInArrow(_features, _FEATURES), "signatures")
    part = rows.where("doc_id IS NOT NULL AND key IS NOT NULL")
    classes = part.groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.count("*").alias("weight"), F.min("sig").alias("sig"))
    classes = written(classes, "classes")

    clusters = candidates(texts, classes, threshold)
    # Clusters of one block need no row here, so the join on a cluster is a broadcast or meets no common key.
    blocks = small(clusters.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(SIDE)).cast("int").alias("n_blocks")).where("n_blocks > 1"))
    n_bins = max(1, math.ceil(clusters.count() / BIN))
    members = clusters.join(blocks, "cluster", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1))).join(classes, "key")
    grams = _fetched(texts, members)
    own = F.pmod(F.xxhash64("key", F.lit(9)), F.col("n_blocks")).cast("int")
    placed = members.select("cluster", "key", "weight", "sig", "n_blocks", own.alias("own")).join(grams, "key")
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    alone = F.col("n_blocks") == 1
    i, j = F.least("own", "with"), F.greatest("own", "with")
    bin_ = F.when(alone, F.pmod(F.xxhash64("cluster"), F.lit(n_bins))).otherwise(F.xxhash64("cluster", i, j))
    placed = placed.select(bin_.cast("long").alias("bin"), "cluster", i.alias("i"), j.alias("j"), F.when(F.col("own") == i, 0).otherwise(1).alias("side"), "key", "weight", "sig", "grams")
    compared = placed.groupBy("bin", F.when(F.col("i") == F.col("j"), F.lit(-1)).otherwise(F.col("i")), F.when(F.col("i") == F.col("j"), F.lit(-1)).otherwise(F.col("j"))).applyInArrow(_group(threshold, tolerance), "key long, links long, root long")
    compared = written(compared, "links")

    links = compared.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(compared.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "key"})
    named = classes.join(roots, "key", "left").join(links, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("least.doc_id").alias("class_id"))
    named = named.join(least, "root").select("key", "root", "class_id", F.col("least.doc_id").alias("copy_of"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.select("doc_id", "text_hash", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(named, "key", "left")
    return out.select("doc_id", "text_hash", "root", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one document of each similarity class, the one with the least id; its columns unchanged.

    Rows with a null id, or without words, all stay.
    """
    found = written(_similar(docs, doc_id, text, **options), "similar")
    gone = found.where(F.col("class_id") != F.col("doc_id")).select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).distinct()
    left = docs.join(gone, (F.col(doc_id).cast("long") == F.col("_gone_id")) & (F.xxhash64(text) == F.col("_gone_hash")), "left_anti")
    # Rows of one class and its least id: one of them stays. An id's rows of other classes, or without links, are others.
    least = found.where("class_id = doc_id AND n_links > 0")
    twice = least.groupBy("doc_id", "root").count().where("count > 1").select("doc_id", "root")
    if twice.isEmpty():
        return left
    twice = least.join(twice, ["doc_id", "root"], "left_semi").select(F.col("doc_id").alias("_twice"), F.col("text_hash").alias("_twice_hash"), F.col("root").alias("_root")).distinct()
    same = (F.col(doc_id).cast("long") == F.col("_twice")) & (F.xxhash64(text) == F.col("_twice_hash"))
    # The one of the least text hash stays; of rows with that text, the one whose columns hash least.
    row = F.struct(*[docs[c] for c in docs.columns])
    plain = [docs[c] for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    some = left.join(twice, same).groupBy("_twice", "_root").agg(F.min_by(row, F.struct("_twice_hash", F.xxhash64(*plain))).alias("_row")).select("_row.*")
    return left.join(twice, same, "left_anti").unionByName(some)
