"""Quality classifier: an interpolated modified Kneser-Ney bigram model of trusted text.

The vocabulary is every word of all texts that occurs twice, up to VOCABULARY of the commonest (what executors hold: 12
bytes a word); any other word is one of a few shapes (lower case, capitalised, upper case, with digits, with symbols).
Documents move as packed word ids in blocks.

Counts are sharded by the context word: a shard has all that follows a word, at most VOCABULARY + shapes entries, so it
knows the word's total and how many followers were seen once, twice and more. Each block asks each shard once for every
distinct pair its documents hold, and gets log probabilities back: what moves grows with the corpus, and a very common
pair costs one entry a block. Log probabilities travel as sixteen bits, steps of 1/2048 nat. Shards answer in WAVES, one
after the other, so that only a part of the questions and answers takes up disk at a time.

    p(w | v) = max(c(v w) - D(c), 0) / c(v) + gamma(v) * q(w),   gamma(v) = (D1 N1(v) + D2 N2(v) + D3 N3+(v)) / c(v)
    q(w)     = max(N(. w) - D'(N), 0) / N(. .) + gamma' / |V|,   discounts from counts of counts

Trusted documents of every FOLDS-th hash are not trained on; a language's threshold is a quantile of their perplexity
(a sketch of bounded size), so that text as good as trusted text is rejected as rarely as the quantile says. Languages
with fewer than min_held such documents take the quantile of all languages together: a quantile of so few is one of them.

Defined cases: a null text counts as empty; a text without words has null perplexity and is not kept; a null language
is one of its own; rows with equal ids are different documents, trusted alike; a null id is never trusted; without
trusted text every document with words is kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import each_piece
from .packed import block_bytes, pack, pack_sorted, unpack, unpack_sorted
from .shared import discard, freeing_shuffles, written
from .tokens import _mix, pieces, span_hashes, text_buffer, words

VOCABULARY = 1 << 20
SHAPES = 5
#: Bits of a word id, and the id that stands before a text's first word.
WORD_BITS = 21
START = (1 << WORD_BITS) - 1
_SHIFT, _WORD = np.uint64(WORD_BITS), np.uint64(START)
FOLDS = 5
QUANTILE = 0.995
MIN_HELD = 50
#: Parts in which shards are asked, one after the other.
WAVES = 4
#: Shards of context words: at least, and words a shard beyond.
SHARDS, SHARD_WORDS = 128, 8_000_000
#: Words of a shard that one group takes; beyond that a shard's blocks are dealt to several groups.
GROUP_WORDS = 64_000_000
_STEP = 2048.0
#: Text bytes hashed at a time.
_PART = 1 << 19

_BLOCK = "block long, ids array<long>, langs array<string>, sizes binary, tokens binary, n_words long"
_SENT = "shard int, block long, codes binary, more binary"


def _word_counts(batches):
    """(word hash, count), summed over each piece of text."""
    for piece in each_piece(batches, "text", 1 << 21):
        found = []
        for part in pieces(piece, "text", _PART):
            buf, offsets = text_buffer(part.column(0))
            starts, ends, _ = words(buf, offsets)
            found.append(span_hashes(buf, starts, ends))
        h, n = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])


def vocabulary(texts: DataFrame, size: int = VOCABULARY) -> np.ndarray:
    """Hashes of the words that occur twice, the commonest first: all of them, or if these are more than size, all that
    occur so often that at most size are left. At most size rows reach the driver."""
    total = texts.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    total = written(total, "words")
    # One row for each different count: some square root of the words.
    often, words_ = (np.asarray(c.combine_chunks()) for c in total.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toArrow().columns)
    fits = often[np.cumsum(words_) <= size]
    top = total.where(F.col("n") >= int(fits[-1])).toArrow() if len(fits) else total.limit(0).toArrow()
    word, n = (np.asarray(top[c].combine_chunks().to_numpy(zero_copy_only=False), np.int64) for c in ("word", "n"))
    return word[np.lexsort((word, -n))].view(np.uint64)


def _flag(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_UPPER, _DIGIT = _flag(bytes(range(65, 91))), _flag(bytes(range(48, 58)))
_PLAIN = _flag(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), *b".,;:!?'\"()-"]))


def by_hash(vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vocabulary's hashes in order, and the rank of each."""
    order = np.argsort(vocab)
    return vocab[order], order.astype(np.uint32)


def token_ids(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, ordered: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shape of words outside the vocabulary (0 .. SHAPES - 1), else SHAPES + the word's rank in it; ordered: by_hash().

    Common words have small ids, so packed ids and pairs are small.
    """
    h, (hashes, ranks) = span_hashes(buf, starts, ends), ordered
    at = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
    rank = ranks[at] if len(hashes) else at
    known = hashes[at] == h if len(hashes) else np.zeros(len(h), dtype=bool)

    def share(flags):
        total = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(flags[buf], out=total[1:])
        return total[ends] - total[starts]

    upper, digits, plain, size = share(_UPPER), share(_DIGIT), share(_PLAIN), ends - starts
    first = _UPPER[buf[starts]] if len(starts) else starts
    shape = np.where(plain < size, 4, np.where(digits > 0, 3, np.where(2 * upper >= size, 2, np.where(first == 1, 1, 0))))
    return np.where(known, rank + np.uint32(SHAPES), shape).astype(np.uint32)


def token_blocks(docs: DataFrame, vocab: np.ndarray) -> DataFrame:
    """Blocks of documents as packed word ids, in a table. docs: id, lang, text."""
    shipped = docs.sparkSession.sparkContext.broadcast(by_hash(vocab))
    limit = 2 * block_bytes(docs.select("text"))

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for piece in each_piece(batches, "text", limit):
            found, sizes = [], []
            for part in pieces(piece, "text", _PART):
                buf, offsets = text_buffer(part.column(2))
                starts, ends, first = words(buf, offsets)
                found.append(token_ids(buf, starts, ends, shipped.value))
                sizes.append(np.diff(first).astype(np.uint32))
            tokens = np.concatenate(found)
            one = [[number], [piece.column(0).to_pylist()], [piece.column(1).to_pylist()], [pack(np.concatenate(sizes))], [pack(tokens)], [len(tokens)]]
            number += 1
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(one, kinds)], names=["block", "ids", "langs", "sizes", "tokens", "n_words"])

    return written(docs.mapInArrow(run, _BLOCK), "tokens")


def _pairs(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """context << WORD_BITS | word for every word; a text's first word follows START."""
    before = np.empty(len(tokens), np.uint64)
    if len(tokens):
        before[1:] = tokens[:-1]
        starts = np.cumsum(sizes) - sizes
        before[starts[sizes > 0]] = START
    return before << _SHIFT | tokens.astype(np.uint64)


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    """By context word."""
    return _mix((codes >> _SHIFT) + np.uint64(1)) % np.uint64(shards)


def _by_shard(codes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct sorted codes by shard (then code), and where each shard begins."""
    shard = shard_of(codes, shards)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))


def _send(block: int, codes: np.ndarray, more: np.ndarray | None, shards: int) -> pa.RecordBatch:
    order, edge = _by_shard(codes, shards)
    rows = [(s, block, pack_sorted(codes[part]), None if more is None else pack(more[part])) for s in range(shards) if len(part := order[edge[s] : edge[s + 1]])]
    a, b, c, d = zip(*rows) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int64()), pa.array(c, pa.binary()), pa.array(d, pa.binary())], names=["shard", "block", "codes", "more"])


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _merged(rows: pa.Table) -> pa.Table:
    """A shard's pairs with their counts over all blocks."""
    codes = np.concatenate([unpack_sorted(x) for x in rows["codes"].to_pylist()])
    n = np.concatenate([unpack(x, np.int64) for x in rows["more"].to_pylist()])
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return pa.table({"shard": pa.array([rows["shard"][0].as_py()], pa.int32()), "codes": pa.array([pack_sorted(codes[at])], pa.binary()), "more": pa.array([pack(np.add.reduceat(n, at))], pa.binary())})


def _statistics(batches):
    """(kind, key, n): kind 0 counts of pairs counted 1 .. 4 times; kind 1 different contexts of a word."""
    for row in _rows(batches):
        codes, n = unpack_sorted(row["codes"]), unpack(row["more"], np.int64)
        word, contexts = np.unique(codes & _WORD, return_counts=True)
        often = np.bincount(np.minimum(n, 5), minlength=6)[1:5]
        yield pa.RecordBatch.from_arrays([pa.array([0] * 4 + [1] * len(word), pa.int32()), pa.array(np.concatenate([np.arange(1, 5), word.astype(np.int64)])), pa.array(np.concatenate([often, contexts]).astype(np.int64))], names=["kind", "key", "n"])


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """D(0) = 0, D(1), D(2), D(3 and more), of modified Kneser-Ney; 0.5, 1, 1.5 where counts of counts are missing."""
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 1e-3, 1e-3, 1e-3], [0, 1, 2, 3])


def lower_order(contexts: np.ndarray, size: int) -> np.ndarray:
    """q(w) for every id, from the number of different contexts of each; size is |V|."""
    total = contexts.sum()
    if total == 0:
        return np.full(len(contexts), 1 / max(size, 1))
    d = discounts(*[float((contexts == k).sum()) for k in (1, 2, 3, 4)])
    cut = d[np.minimum(contexts, 3)]
    return np.maximum(contexts - cut, 0) / total + cut.sum() / total / max(size, 1)


def log_probabilities(codes: np.ndarray, counts: np.ndarray, asked: np.ndarray, d: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Natural log of p(w | v) for asked pairs, from the sorted pairs and counts of a shard."""
    base = q[(asked & _WORD).astype(np.int64)]
    if not len(codes):
        return np.log(base)
    context = codes >> _SHIFT
    at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    total = np.add.reduceat(counts, at).astype(np.float64)
    held = np.add.reduceat(d[np.minimum(counts, 3)], at)
    place = np.minimum(np.searchsorted(context[at], asked >> _SHIFT), len(at) - 1)
    seen = context[at][place] == asked >> _SHIFT
    pair = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
    n = np.where(codes[pair] == asked, counts[pair], 0)
    own = np.maximum(n - d[np.minimum(n, 3)], 0) / total[place]
    return np.log(np.where(seen, own + held[place] / total[place] * base, base))


def _quantised(log_p: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(-log_p * _STEP), 65_535).astype(np.uint16)


_MODEL = "shard int, codes binary, more binary"


def train(blocks: DataFrame, trusted: DataFrame, shards: int, groups: int, size: int) -> tuple[DataFrame, np.ndarray, np.ndarray, bool]:
    """The sharded counts of the trusted documents' pairs, the discounts, each word's different contexts (size words), and
    whether there are any."""
    spark = blocks.sparkSession
    where = blocks.select("block", F.posexplode("ids").alias("pos", "id")).join(trusted, "id").where("NOT held")
    lists = where.groupBy("block").agg(F.collect_list("pos").alias("chosen"))

    def count(batches):
        for row in _rows(batches):
            sizes, tokens = unpack(row["sizes"], np.uint32).astype(np.int64), unpack(row["tokens"], np.uint32)
            chosen = np.zeros(len(sizes), dtype=bool)
            chosen[row["chosen"]] = True
            code, n = np.unique(_pairs(tokens, sizes)[np.repeat(chosen, sizes)], return_counts=True)
            yield _send(row["block"], code, n.astype(np.int64), shards)

    with freeing_shuffles(spark):
        sent = blocks.join(lists, "block").mapInArrow(count, _SENT)
        if groups > 1:
            sent = sent.groupBy("shard", F.pmod(F.xxhash64("block"), F.lit(groups))).applyInArrow(_merged, _MODEL)
        model = written(sent.groupBy("shard").applyInArrow(_merged, _MODEL), "model")
        # 4 counts of counts and one row for each word of the vocabulary.
        found = model.mapInArrow(_statistics, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()
    kind, key, n = (np.asarray(c.combine_chunks()) for c in found.columns)
    often = dict(zip(key[kind == 0].tolist(), n[kind == 0].tolist()))
    contexts = np.zeros(size, np.int64)
    contexts[key[kind == 1]] = n[kind == 1]
    return model, discounts(*[float(often.get(k, 0)) for k in (1, 2, 3, 4)]), contexts, bool(often)


def perplexities(blocks: DataFrame, model: DataFrame, d: np.ndarray, q: np.ndarray, shards: int, groups: int) -> DataFrame:
    """(id, lang, n_words, log_prob) of every document."""
    spark = blocks.sparkSession
    shipped = spark.sparkContext.broadcast((d, q))

    def answer(rows: pa.Table) -> pa.Table:
        d, q = shipped.value
        codes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        asked = []
        for b, c, m in zip(rows["block"].to_pylist(), rows["codes"].to_pylist(), rows["more"].to_pylist()):
            if b is None:
                codes, counts = unpack_sorted(c), unpack(m, np.int64)
            else:
                asked.append((b, c))
        told = [pack(_quantised(log_probabilities(codes, counts, unpack_sorted(c), d, q))) for _, c in asked]
        shard = rows["shard"][0].as_py()
        return pa.table({"block": pa.array([b for b, _ in asked], pa.int64()), "shard": pa.array([shard] * len(asked), pa.int32()), "values": pa.array(told, pa.binary())})

    def wave_of(row: dict, wave: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of a block's words, which of them this wave asks for, and the words of each document."""
        sizes = unpack(row["sizes"], np.uint32).astype(np.int64)
        pairs = _pairs(unpack(row["tokens"], np.uint32), sizes)
        return pairs, shard_of(pairs, shards) % np.uint64(WAVES) == np.uint64(wave), sizes

    def asking(wave: int):
        def ask(batches):
            for row in _rows(batches):
                pairs, mine, _ = wave_of(row, wave)
                yield _send(row["block"], np.unique(pairs[mine]), None, shards)

        return ask

    def totalling(wave: int):
        def total(batches):
            for row in _rows(batches):
                pairs, mine, sizes = wave_of(row, wave)
                codes, back = np.unique(pairs[mine], return_inverse=True)
                order, edge = _by_shard(codes, shards)
                value = np.zeros(len(codes))
                for part in row["told"] or []:
                    value[order[edge[part["shard"]] : edge[part["shard"] + 1]]] = unpack(part["values"], np.uint16) / _STEP
                cost = np.zeros(len(pairs) + 1)
                cost[1:][mine] = value[back]
                np.cumsum(cost, out=cost)
                ends = np.cumsum(sizes)
                log_prob = -(cost[ends] - cost[ends - sizes])
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(sizes), pa.int64()), pa.array(np.arange(len(sizes), dtype=np.int32)), pa.array(row["ids"], pa.int64()), pa.array(row["langs"], pa.string()), pa.array(sizes), pa.array(log_prob)], names=["block", "pos", "id", "lang", "n_words", "log_prob"])

        return total

    # A shard's counts are at most some contexts' followers; each of its groups gets them.
    known = model.select("shard", F.lit(None).cast("long").alias("block"), "codes", "more", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    parts = []
    with freeing_shuffles(spark):
        for wave in range(WAVES):
            requests = blocks.mapInArrow(asking(wave), _SENT).withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
            replies = written(requests.union(known.where(F.col("shard") % WAVES == wave)).groupBy("shard", "part").applyInArrow(answer, "block long, shard int, values binary"), "answers")
            told = replies.groupBy("block").agg(F.collect_list(F.struct("shard", "values")).alias("told"))
            parts.append(written(blocks.join(told, "block", "left").mapInArrow(totalling(wave), "block long, pos int, id long, lang string, n_words long, log_prob double"), "scores"))
            discard(replies)
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    whole = rows.groupBy("block", "pos").agg(F.first("id").alias("id"), F.first("lang").alias("lang"), F.first("n_words").alias("n_words"), F.sum("log_prob").alias("log_prob"))
    return written(whole.drop("block", "pos"), "scores")


def classify(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", lang: str = "lang", text: str = "text", quantile: float = QUANTILE, shards: int | None = None, min_held: int = MIN_HELD) -> DataFrame:
    """(doc_id, lang, n_words, log_prob, perplexity, threshold, kept). trusted: one column, the ids of trusted documents."""
    cols = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    vocab = vocabulary(cols.select("text"))
    blocks = token_blocks(cols, vocab)
    total = blocks.agg(F.sum("n_words")).head()[0] or 0
    shards = shards or min(VOCABULARY // 4, max(SHARDS, math.ceil(total / SHARD_WORDS)))
    groups = max(1, math.ceil(total / shards / GROUP_WORDS))
    held = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(FOLDS)) == 0
    marks = trusted.select(F.col(trusted.columns[0]).cast("long").alias("id")).where("id IS NOT NULL").distinct().withColumn("held", held)
    size = len(vocab) + SHAPES
    model, d, contexts, trained = train(blocks, marks, shards, groups, size)
    scored = perplexities(blocks, model, d, lower_order(contexts, size), shards, groups)
    scored = scored.withColumn("perplexity", F.when(F.col("n_words") > 0, F.exp(-F.col("log_prob") / F.col("n_words"))))

    sample = scored.where("n_words > 0").join(marks.where("held"), "id", "left_semi")
    sketch = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    # One row a language, and one for all: the sketch holds so many values at most.
    each = sample.groupBy("lang").agg(sketch.alias("own"), F.count("*").alias("n")).where(F.col("n") >= min_held)
    overall = sample.agg(sketch).head()[0] if trained else None
    key = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("null"))
    limits = each.select(key.alias("_lang"), "own")
    out = scored.withColumn("_lang", key).join(limits, "_lang", "left")
    threshold = F.coalesce("own", F.lit(overall).cast("double"), F.lit(math.inf))
    kept = F.col("perplexity").isNotNull() & (F.coalesce("perplexity", F.lit(0.0)) <= threshold)
    return out.select(F.col("id").alias(doc_id), "lang", "n_words", "log_prob", "perplexity", threshold.alias("threshold"), kept.alias("kept"))
