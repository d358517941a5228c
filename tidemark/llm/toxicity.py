"""Toxicity by nearest labelled examples: exact cosine of weighted TF-IDF with every example.

Examples are labelled documents, at most EXAMPLES of each class, chosen by hash of the id: that bound is a parameter.
Terms are lower-case words and their beginnings of 4 to 8 bytes, for compounds; all terms of the examples make the
vocabulary. Weights are (1 + log tf) * idf * contrast, scaled to length 1, with idf from the number of documents of the
whole table that hold the term. The contrast, by which a term differs between the classes, is never 0; without it what
a text is about outweighs its few toxic words.

The index is block-max: examples stand in blocks of BLOCK, and each term knows its greatest weight in each block that
holds it. Terms of more than a DENSE-th of the examples stand in a matrix, whose product gives their exact part of all
cosines; the others stand in postings. The best exact part in a block and the greatest weights bound its cosines. Only
postings of blocks whose bound reaches the K-th best exact part are read: the nearest examples are exact.

Votes weigh cosine ** POWER times how many labelled documents an example stands for, and PRIOR pseudo-votes at the
labelled share draw votes with little evidence to it. An example with the text itself has no vote, so no label decides
its own document's score. The toxic share of votes becomes a probability by a logistic curve (Platt's, with his
smoothed targets) that is fit on the examples' own shares, each without its own text. A score depends on the text alone.

Nothing is shuffled but the examples and one document count a term and task; the index, whose size the bound fixes, is
broadcast; the driver holds terms of examples, never texts.

Defined cases: a null or wordless text, or one without vocabulary terms, has the labelled share of votes; no labelled
examples at all give 0; equal texts score alike; a null id is never an example and is kept as null; an id labelled both
ways is no example, and of an id's several texts the one of the least hash is; equal neighbours go by the smaller id; an
empty table gives an empty result. Texts are read whole, very long ones too; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packed import pack, pack_sorted, unpack, unpack_sorted
from .tokens import pieces, running_hash, span_hashes, text_buffer, words

EXAMPLES = 1500
BLOCK = 256
PREFIXES = (4, 5, 6, 7, 8)
#: Terms of more than one in so many examples are compared by a matrix product.
DENSE = 25
K = 15
POWER = 2.0
PRIOR = 1.0
THRESHOLD = 0.3

_BREAK = np.ones(256, dtype=bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _folded(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of Latin letters that UTF-8 starts with C3."""
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    second = np.zeros(len(buf), dtype=bool)
    second[1:] = buf[:-1] == 0xC3
    out[second & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97)] += 32
    return out


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Term hashes of all texts with the text of each, and the number of texts."""
    buf, offsets = text_buffer(column)
    buf = _folded(buf)
    starts, ends, first = words(buf, offsets, _BREAK)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    total = running_hash(buf)
    found, of = [span_hashes(buf, starts, ends, total=total)], [doc]
    for k in PREFIXES:
        longer = ends - starts > k
        # Another multiplier for each length: a beginning is not the word of the same bytes.
        found.append(span_hashes(buf, starts[longer], starts[longer] + k, total=total) * np.uint64(2 * k + 1))
        of.append(doc[longer])
    return np.concatenate(found), np.concatenate(of), len(offsets) - 1


def lookup(vocab: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Where the sorted hashes of each run of leading bits begin, the shift to those bits, and the longest run."""
    bits = int(np.clip(len(vocab), 2, 1 << 20) - 1).bit_length() + 1
    edge = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    first = np.append(np.searchsorted(vocab, edge), len(vocab)).astype(np.int32)
    return first, 64 - bits, int(np.diff(first).max())


def counts(column: pa.Array, vocab: np.ndarray, table: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(text, term, tf) of the sorted vocabulary's terms in the texts, by text, then term; and the number of texts. table: lookup(vocab)."""
    h, doc, n = terms(column)
    if not len(vocab):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), n
    first, shift, longest = table or lookup(vocab)
    bucket = (h >> np.uint64(shift)).astype(np.int64)
    at, end = first[bucket], first[bucket + 1]
    keys = []
    for _ in range(longest):
        left = at < end
        h, doc, at, end = h[left], doc[left], at[left], end[left]
        hit = vocab[at] == h
        keys.append(doc[hit] * np.int64(len(vocab)) + at[hit])
        h, doc, at, end = h[~hit], doc[~hit], at[~hit] + 1, end[~hit]
    key, tf = np.unique(np.concatenate(keys), return_counts=True)
    return key // len(vocab), key % len(vocab), tf, n


def _weights(doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(tf)) * idf[term]
    norm = np.sqrt(np.bincount(doc, w * w, minlength=n))
    return w / np.where(norm > 0, norm, 1)[doc]


def _runs(texts: pa.Array, limit: int = 1 << 20):
    """Slices of about so many bytes, with the position of each one's first text."""
    at = 0
    for piece in pieces(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", limit):
        yield at, piece.column(0)
        at += piece.num_rows


def held_terms(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct terms of each text in order, and how often each occurs."""
    out = []
    for _, part in _runs(texts):
        h, doc, n = terms(part)
        order = np.argsort(doc, kind="stable")
        h, edge = h[order], np.searchsorted(doc[order], np.arange(n + 1))
        out += [np.unique(h[edge[i] : edge[i + 1]], return_counts=True) for i in range(n)]
    return out


def vocabulary(held: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The distinct terms of the examples in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in held)]))


def document_counts(texts: pa.Array, vocab: np.ndarray, table: tuple | None = None) -> np.ndarray:
    """In how many of the texts each term is."""
    total = np.zeros(len(vocab), np.int64)
    for _, part in _runs(texts):
        total += np.bincount(counts(part, vocab, table)[1], minlength=len(vocab))
    return total


def gathered(ids: np.ndarray, held: list, hashes: np.ndarray, toxic: np.ndarray, totals: tuple[int, int], known: tuple[np.ndarray, np.ndarray, int]) -> dict:
    """What the index is built from, packed: it is sent to executors, which build the index. Classes stand apart, so that
    blocks hold similar examples."""
    arranged = np.lexsort((ids, toxic))
    vocab, df, n_docs = known
    keys = [np.zeros(0, np.uint64), *(np.uint64(k) * np.uint64(len(vocab)) + np.searchsorted(vocab, held[i][0]).astype(np.uint64) for k, i in enumerate(arranged))]
    tfs = [np.zeros(0, np.uint32), *(held[i][1].astype(np.uint32) for i in arranged)]
    return {"ids": ids[arranged], "hashes": hashes[arranged], "toxic": toxic[arranged], "totals": totals, "vocabulary": pack_sorted(vocab), "df": pack(df.astype(np.int64)), "n_docs": n_docs, "keys": pack_sorted(np.concatenate(keys)), "tf": pack(np.concatenate(tfs))}


def contrast(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """How much terms differ between the classes, from how many of n1 toxic and n0 other examples hold each: the
    correlation with the class, plus its sampling error, so that no term weighs nothing."""
    mean = (a + b) / max(n1 + n0, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12) * (n1 + n0) ** 2 / max(n1 * n0, 1))
    return np.abs(a / max(n1, 1) - b / max(n0, 1)) / spread + 1 / np.sqrt(max(n1 + n0, 1))


def built(g: dict) -> dict:
    """The index: weights of common terms as a matrix, of others as postings."""
    ids, toxic, totals, n = g["ids"], g["toxic"], g["totals"], len(g["ids"])
    vocab, df, tf = unpack_sorted(g["vocabulary"]), unpack(g["df"], np.int64), unpack(g["tf"], np.uint32)
    doc, term = np.divmod(unpack_sorted(g["keys"]).astype(np.int64), max(len(vocab), 1))
    n1, n0 = float(toxic.sum()), float(n - toxic.sum())
    held = np.bincount(term, minlength=len(vocab))
    in_toxic = np.bincount(term, toxic[doc], minlength=len(vocab))
    idf = (np.log((g["n_docs"] + 1) / (df + 1)) + 1) * contrast(in_toxic, held - in_toxic, n1, n0)
    weight = _weights(doc, term, tf, n, idf)
    common = np.flatnonzero(held * DENSE > n)
    row = np.full(len(vocab), -1, np.int32)
    row[common] = np.arange(len(common))
    in_dense = row[term] >= 0
    dense = np.zeros((len(common), n))
    dense[row[term[in_dense]], doc[in_dense]] = weight[in_dense]
    doc, term, weight = doc[~in_dense], term[~in_dense], weight[~in_dense]
    by_term = np.lexsort((doc, term))
    term, doc, weight = term[by_term], doc[by_term], weight[by_term]
    # Entries: the stretch of postings of a term in a block, and the greatest weight there.
    new = np.ones(len(term), dtype=bool)
    new[1:] = (term[1:] != term[:-1]) | (doc[1:] // BLOCK != doc[:-1] // BLOCK)
    entry = np.flatnonzero(new)
    entries = {"block": (doc[entry] // BLOCK).astype(np.int32), "most": np.maximum.reduceat(weight, entry) if len(entry) else weight, "start": np.append(entry, len(term)), "of": np.searchsorted(term[entry], np.arange(len(vocab) + 1))}
    blocks = max(1, -(-n // BLOCK))
    share = totals[1] / max(sum(totals), 1)
    stands_for = np.where(toxic, totals[1] / max(n1, 1), totals[0] / max(n0, 1))
    mean_vote = float(stands_for.mean()) if n else 1.0
    return {"vocabulary": vocab, "table": lookup(vocab), "idf": idf, "ids": ids, "hashes": g["hashes"], "toxic": toxic, "stands_for": stands_for / mean_vote, "row": row, "dense": dense, "blocks": blocks, "entries": entries, "post_doc": doc.astype(np.int32), "post_weight": weight, "share": share}


def fit(ids: np.ndarray, texts: pa.Array, toxic: np.ndarray, totals: tuple[int, int]) -> dict:
    """The index over the examples, as if they were the whole table. totals: labelled documents of class 0 and 1 for which the examples stand."""
    held = held_terms(texts)
    vocab = vocabulary(held)
    return built(gathered(ids, held, ids, toxic, totals, (vocab, document_counts(texts, vocab), len(texts))))


#: Texts compared at a time, entries and postings added at a time.
_TEXTS, _POSTINGS = 128, 1 << 21


def _added(out: np.ndarray, doc: np.ndarray, first: np.ndarray, size: np.ndarray, weight: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
    """Add weight * value[j] to out[doc, place[j]] for the size values j from first; rows are sorted by doc."""
    total, at = np.cumsum(size), 0
    while at < len(doc):
        to = max(at + 1, int(np.searchsorted(total, total[at] - size[at] + _POSTINGS, side="right")))
        c = size[at:to]
        take = np.repeat(first[at:to] - np.cumsum(c) + c, c) + np.arange(c.sum())
        low, high = doc[at], doc[to - 1] + 1
        flat = np.repeat((doc[at:to] - low) * out.shape[1], c) + place[take]
        out[low:high] += np.bincount(flat, value[take] * np.repeat(weight[at:to], c), minlength=(high - low) * out.shape[1]).reshape(-1, out.shape[1])
        at = to


def cosines(index: dict, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """Cosines of n texts with the examples, 0 where a block can't hold one of the k nearest; doc, term and weight are sorted by text."""
    m, blocks, entries = len(index["ids"]), index["blocks"], index["entries"]
    row = index["row"][term]
    dense = row >= 0
    query = np.zeros((n, len(index["dense"])))
    query[doc[dense], row[dense]] = weight[dense]
    doc, term, weight = doc[~dense], term[~dense], weight[~dense]
    # Common terms of all examples by one product; their blocks' bounds are exact, those of other terms are added.
    out = query @ index["dense"]
    bound = np.maximum.reduceat(out, np.arange(0, m, BLOCK), axis=1) if m else np.zeros((n, blocks))
    first, size = entries["of"][term], entries["of"][term + 1] - entries["of"][term]
    _added(bound, doc, first, size, weight, entries["block"], entries["most"])
    # The k-th of the exact parts is at most the true k-th cosine. One neighbour more than k: the text may be an example.
    kth = np.partition(out, m - min(k + 1, m), axis=1)[:, m - min(k + 1, m)] if m else np.zeros(n)
    wanted = bound >= kth[:, None] - 1e-9
    start = entries["start"]
    whole = wanted.all(1)
    some = whole[doc]
    low, high = start[entries["of"][term[some]]], start[entries["of"][term[some] + 1]]
    _added(out, doc[some], low, high - low, weight[some], index["post_doc"], index["post_weight"])
    # Of the other texts the entries of wanted blocks alone.
    doc, first, size, weight = doc[~some], first[~some], size[~some], weight[~some]
    which = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
    asker, part = np.repeat(doc, size), np.repeat(weight, size)
    keep = wanted[asker, entries["block"][which]]
    e = which[keep]
    _added(out, asker[keep], start[e], start[e + 1] - start[e], part[keep], index["post_doc"], index["post_weight"])
    out[~np.repeat(wanted, BLOCK, axis=1)[:, :m]] = 0
    return out


def _best(index: dict, cosine: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    # Sums in different orders may part equal cosines in the last bits: compare them rounded. Examples stand by id.
    some = np.flatnonzero(cosine > 0)
    if own is not None:
        some = some[index["hashes"][some] != own]
    if len(some) > k:
        least = np.partition(cosine[some], len(some) - k)[len(some) - k]
        some = some[cosine[some] >= least - 1e-9]
    best = some[np.lexsort((index["ids"][some], -np.round(cosine[some], 10)))[:k]]
    return best, cosine[best]


def nearest(index: dict, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and cosines of the k nearest examples with a cosine over 0; ties to smaller ids."""
    return _best(index, cosines(index, np.zeros(len(term), np.int64), term, weight, 1, k)[0], k)


def vote(index: dict, found: np.ndarray, cosine: np.ndarray) -> float:
    w = np.round(cosine, 10) ** POWER * index["stands_for"][found]
    return float((w[index["toxic"][found]].sum() + PRIOR * index["share"]) / (w.sum() + PRIOR))


def _votes(index: dict, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, list]:
    """The toxic share of votes of each text, and its neighbours' ids."""
    n = len(hashes)
    shares, evidence, edge = np.full(n, index["share"]), [[] for _ in range(n)], np.searchsorted(doc, np.arange(n + 1))
    for low in range(0, n, _TEXTS):
        high = min(n, low + _TEXTS)
        part = slice(edge[low], edge[high])
        cosine = cosines(index, doc[part] - low, term[part], weight[part], high - low, k)
        for i in low + np.flatnonzero(np.diff(edge[low : high + 1])):
            found, near = _best(index, cosine[i - low], k, hashes[i])
            shares[i], evidence[i] = vote(index, found, near), index["ids"][found].tolist()
    return shares, evidence


def _odds(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return np.log(share / (1 - share))


def calibrated(curve: tuple[float, float], share: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] * _odds(share) + curve[1], -500, 500)))


def calibration(share: np.ndarray, toxic: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve from log odds of votes to log odds of the label, by Newton steps; targets
    are Platt's. Without both classes, or where votes tell nothing, the votes stay as they are."""
    if not toxic.any() or toxic.all():
        return 1.0, 0.0
    x, n1, n0 = _odds(share), weight[toxic].sum(), weight[~toxic].sum()
    y = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0

    def loss(a, b):
        z = a * x + b
        return (weight * (np.logaddexp(0, z) - y * z)).sum()

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        g, h = weight * (p - y), weight * p * (1 - p)
        hessian = np.array([[(h * x * x).sum() + 1e-9, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hessian, np.array([(g * x).sum(), g.sum()]))
        size, old = 1.0, loss(a, b)
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > old:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(size * step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def _curve(g: dict, k: int) -> tuple[float, float]:
    """The calibration from the examples' own votes, each example weighing as many labelled documents as it stands for."""
    index = built(g)
    n = len(index["ids"])
    doc, term = np.divmod(unpack_sorted(g["keys"]).astype(np.int64), max(len(index["vocabulary"]), 1))
    weight = _weights(doc, term, unpack(g["tf"], np.uint32), n, index["idf"])
    shares, _ = _votes(index, doc, term, weight, index["hashes"], k)
    return calibration(shares, index["toxic"].astype(bool), index["stands_for"])


def _frequencies(docs: DataFrame, vocab: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each term is, and how many documents there are; a task sends a row a term at most."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocab)

    def count(batches):
        vocab = shipped.value
        table = lookup(vocab)
        total, n = np.zeros(len(vocab), np.int64), 0
        for batch in batches:
            total += document_counts(batch.column(0), vocab, table)
            n += batch.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], some])), pa.array(np.concatenate([[n], total[some]]))], names=["term", "n"])

    # One row for each term of the examples, whose number the bounds fix, and one for the documents.
    found = docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = (found[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("term", "n"))
    df = np.zeros(len(vocab) + 1, np.int64)
    df[term] = n
    return df[:-1], int(df[-1])


_EXAMPLE = "id long, toxic boolean, hash long, terms binary, tf binary"


def _example_rows(batches):
    for batch in batches:
        held = held_terms(batch.column(3))
        packed = [pa.array([pack_sorted(h) for h, _ in held], pa.binary()), pa.array([pack(n.astype(np.uint32)) for _, n in held], pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *packed], names=["id", "toxic", "hash", "terms", "tf"])


_OUT = "id long, score double, evidence array<long>"


def score(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, examples: int = EXAMPLES) -> DataFrame:
    """(doc_id, score, evidence: the neighbours' ids). labelled: (id, toxic) of the documents to learn from."""
    spark = docs.sparkSession
    marks = labelled.select(F.col(labelled.columns[0]).cast("long").alias("id"), (F.col(labelled.columns[1]) == 1).alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL")
    marks = marks.groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").select("id", "toxic")
    totals = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    # Not more than the bound of each class, by hash of the id: a share that gives somewhat more, then the first.
    share = [int(min(1.0, (examples + 4 * examples**0.5 + 16) / max(totals.get(c, 0), 1)) * (1 << 31)) for c in (False, True)]
    hashed = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 31))
    some = marks.withColumn("h", hashed).where(F.col("h") < F.when(F.col("toxic"), share[1]).otherwise(share[0]))
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    # One text an id, then the first of each class: about twice the bound of rows, whose terms alone reach the driver.
    own = texts.join(F.broadcast(some), "id").groupBy("id", "toxic", "h").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("own"))
    own = own.orderBy("h", "id").limit(2 * examples + 400).select("id", "toxic", "own.hash", "own.text")
    rows = own.mapInArrow(_example_rows, _EXAMPLE).withColumn("h", hashed).orderBy("h", "id").toArrow() if totals else None
    index = None
    if rows is not None and rows.num_rows:
        toxic, ids, hashes = (rows[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("toxic", "id", "hash"))
        toxic = toxic.astype(bool)
        keep = np.sort(np.concatenate([np.flatnonzero(toxic == c)[:examples] for c in (False, True)]))
        held = [(unpack_sorted(h), unpack(n, np.uint32)) for h, n in zip(rows["terms"].take(pa.array(keep)).to_pylist(), rows["tf"].take(pa.array(keep)).to_pylist())]
        vocab = vocabulary(held)
        index = gathered(ids[keep], held, hashes[keep], toxic[keep], (totals.get(False, 0), totals.get(True, 0)), (vocab, *_frequencies(docs.select(F.col(text).alias("text")), vocab)))
    shipped = spark.sparkContext.broadcast(index and {"packed": index})

    def fit_curve(batches):
        for _ in batches:
            a, b = _curve(shipped.value["packed"], k)
            yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([b])], names=["a", "b"])

    # One task, over examples alone.
    curve = tuple(spark.range(0, 1, 1, 1).mapInArrow(fit_curve, "a double, b double").head()) if index else (1.0, 0.0)

    def run(batches):
        index = shipped.value
        if index and "built" not in index:
            # Built once a worker, which keeps the broadcast value.
            index["built"] = built(index["packed"])
        index = index and index["built"]
        for batch in batches:
            for piece in pieces(batch, "text"):
                n = piece.num_rows
                scores, evidence = np.zeros(n), [[] for _ in range(n)]
                if index:
                    doc, term, tf, _ = counts(piece.column(1), index["vocabulary"], index["table"])
                    shares, evidence = _votes(index, doc, term, _weights(doc, term, tf, n, index["idf"]), piece.column(2).to_numpy(zero_copy_only=False), k)
                    scores = calibrated(curve, shares)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(scores), pa.array(evidence, pa.list_(pa.int64()))], names=["id", "score", "evidence"])

    found = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash")).mapInArrow(run, _OUT)
    return found.withColumnRenamed("id", doc_id)


def held_out(doc_id: Column) -> Column:
    """Documents of which no label is learnt: CRC-32 of the id as text, modulo 4, is 2."""
    return F.crc32(doc_id.cast("string")) % 4 == 2
