"""PII: base patterns, and information-theoretic sanitisation of what reveals them.

Base spans are e-mail addresses, IPv4 addresses, payment card numbers (Luhn) and international phone numbers. Every
distinct value is a protected entity. Corpus co-occurrence then tells which terms give an entity away. A term is a word
of at least MIN_TERM code points; it co-occurs with an entity wherever both stand in one document, however far apart.
With p() the share of all documents,

    PMI(entity; term) = log p(entity, term) / (p(entity) p(term)),      IC(entity) = -log p(entity),

and a term discloses an entity if PMI >= THRESHOLD * IC and the two share documents of at least MIN_SUPPORT similarity
classes (of the n-gram Jaccard join, so near copies of one text prove nothing). Every occurrence of a disclosing term, in
any document, becomes a span of kind ``term``: such terms tell on their own. Sanitising replaces base spans by their
kind, generalises a term that starts with a capital or holds a digit to its class, and removes other terms.

An entity in fewer than MIN_SUPPORT different texts can't be disclosed, and one in a PUBLIC share of the documents or
more has too little information to protect: neither costs more than its count. Only the texts of the others are fetched,
by a broadcast of their hashes where these are few, and only hashes of their terms are shuffled, summed first. How many
documents hold a candidate term is counted over all documents, a sum a task. Up to MAX_TERMS candidates, or disclosing
terms, go to executors as sorted hashes; more meet the documents' terms in a join.

Defined cases: a null text counts as empty; a null id is kept as null; equal rows are scanned alike and each returned;
an empty table gives an empty result; other columns pass through a sanitised table unchanged; a term that overlaps a base
span is none. Texts are scanned whole, very long ones too; every pattern is scanned in linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import each_piece, fresh
from .ngram_join import similar
from .packed import find
from .shared import freeing_shuffles, small, small_batches, written
from .tokens import PIECE, pieces, span_hashes, text_buffer, words
from .toxicity import _BREAK, _folded

KINDS = ("email", "ip", "card", "phone", "term")
MIN_TERM = 4
MIN_SUPPORT = 3
THRESHOLD = 0.9
PUBLIC = 0.1

# The base patterns. E-mail is scanned from its @, with the same result as from the left.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    if text.count(".") >= 3:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                yield m.span()


def luhn(digits: str) -> bool:
    values = [int(d) for d in digits]
    return (sum(values[-1::-2]) + sum(d * 2 - 9 * (d > 4) for d in values[-2::-2])) % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield m.span()


_SCANS = (_emails, _ips, _cards, _phones)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, by start, then kind."""
    return sorted((a, k, b) for k, scan in enumerate(_SCANS) for a, b in scan(text))


def entity_key(kind: int, value: str) -> str:
    """Spellings of one value are one entity: letters in lower case, of numbers the digits alone."""
    return f"{kind}:{value.lower() if kind < 2 else re.sub('[^0-9]', '', value)}"


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of at least MIN_TERM code points of all texts: hash, text, start and end in code points of the text.

    Words are runs of ASCII letters, digits and other than ASCII characters; ASCII and Latin letters count in lower case.
    """
    buf, offsets = text_buffer(column)
    starts, ends, first = words(buf, offsets, _BREAK)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
    long = points[ends] - points[starts] >= MIN_TERM
    starts, ends, doc = starts[long], ends[long], doc[long]
    origin = points[offsets[:-1]][doc]
    return span_hashes(_folded(buf), starts, ends), doc, points[starts] - origin, points[ends] - origin


_ENTITY = "text_hash long, entity long"
_TERMS = "text_hash long, terms array<long>"


def _entity_rows(batches):
    """The distinct entities of each text."""
    for batch in batches:
        hashes, found = [], []
        for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = {_hash(entity_key(k, text[a:b])) for a, k, b in base_spans(text)} if text else ()
            hashes += [h] * len(own)
            found += own
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(found, pa.int64())], names=["text_hash", "entity"])


def _distinct_terms(batches):
    """The distinct terms of each text, those of its base spans left out."""
    for piece in each_piece(batches, "text", PIECE):
        h, doc, start, end = terms_of(piece.column(1))
        edge = np.searchsorted(doc, np.arange(piece.num_rows + 1))
        found = []
        for i, text in enumerate(piece.column(1).to_pylist()):
            part = slice(edge[i], edge[i + 1])
            own = h[part][~_overlapping(start[part], end[part], base_spans(text or ""))]
            found.append(np.unique(own).view(np.int64))
        yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found, pa.list_(pa.int64()))], names=["text_hash", "terms"])


def _overlapping(start: np.ndarray, end: np.ndarray, spans: list) -> np.ndarray:
    """Which of these stretches, in order, share a code point with a span."""
    out = np.zeros(len(start), dtype=bool)
    for a, _, b in spans:
        out[np.searchsorted(end, a, side="right") : np.searchsorted(start, b)] = True
    return out


def _sorted_terms(terms: DataFrame) -> np.ndarray:
    """Distinct hashes in unsigned order; the caller has checked their number."""
    column = terms.toArrow()["term"].combine_chunks()
    return np.sort(column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def _documents_with(texts: DataFrame, terms: DataFrame, most: int) -> DataFrame:
    """(term, n): how many documents hold each of the terms."""
    if terms.count() > most:
        each = texts.mapInArrow(_counted(None), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        return each.join(terms, "term", "left_semi")
    return texts.mapInArrow(_counted(texts.sparkSession.sparkContext.broadcast(_sorted_terms(terms))), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _counted(shipped):
    """Rows (term, n) of a task: documents that hold each term of the broadcast, or each term of a piece of texts."""

    def run(batches):
        wanted = None if shipped is None else shipped.value
        total = None if wanted is None else np.zeros(len(wanted), np.int64)
        for piece in each_piece(batches, "text", PIECE):
            h, doc, _, _ = terms_of(piece.column(0))
            if wanted is None:
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                term, n = np.unique(h[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])
            elif len(wanted):
                at, there = find(wanted, h)
                np.add.at(total, np.unique(doc[there] * len(wanted) + at[there]) % len(wanted), 1)
        if wanted is not None:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(total[some])], names=["term", "n"])

    return run


def disclosing(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, min_support: int = MIN_SUPPORT, public: float = PUBLIC, max_terms: int | None = None) -> DataFrame:
    """(entity, term, n_entity, n_term, n_both, n_classes), hashes and counts of documents: the pairs whose pointwise
    mutual information reaches the threshold."""
    most = MAX_TERMS if max_terms is None else max_terms
    texts = docs.select(F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    some = texts.where(F.col("text").rlike("[@+]|[0-9]"))
    held = written(some.mapInArrow(_entity_rows, _ENTITY).groupBy("entity", "text_hash").agg(F.count("*").alias("n")), "entities")
    total = docs.count()
    entities = held.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("n_texts"))
    entities = written(entities.where((F.col("n_texts") >= min_support) & (F.col("n_entity") < public * total)).select("entity", "n_entity"), "recurring")
    schema = "entity long, term long, n_entity long, n_term long, n_both long, n_classes long"
    if entities.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    held = held.join(entities.select("entity"), "entity", "left_semi")
    fetched = small(held.select("text_hash").distinct(), most)
    own = written(some.join(fetched, "text_hash", "left_semi").dropDuplicates(["text_hash"]), "texts")
    classes = similar(own, "text_hash", "text").select(F.col("doc_id").alias("text_hash"), "class_id")
    terms = own.mapInArrow(_distinct_terms, _TERMS)
    pairs = held.join(classes, "text_hash").join(terms, "text_hash").select("entity", "class_id", "n", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("entity", "term", "class_id").agg(F.sum("n").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("n_classes"))
    pairs = written(pairs.where(F.col("n_classes") >= min_support), "pairs")
    counts = _documents_with(texts.select("text"), written(pairs.select("term").distinct(), "candidates"), most).select("term", F.col("n").alias("n_term"))
    known = pairs.join(entities, "entity").join(counts, "term")
    n = F.lit(float(max(total, 1)))
    pmi = F.log(F.col("n_both") * n / (F.col("n_entity") * F.col("n_term")))
    return known.where(pmi >= threshold * F.log(n / F.col("n_entity")) - 1e-12).select(*[c.split()[0] for c in schema.split(", ")])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_FOUND = T.StructType([T.StructField("spans", SPANS), T.StructField("clean", T.StringType())])
#: Terms that go to executors as sorted hashes, 8 bytes each.
MAX_TERMS = 1_000_000


def generalise(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with base spans replaced by their kind; a term becomes its class if it has one, else it is removed."""
    out, at = [], 0
    for a, k, b in sorted(spans, key=lambda s: (s[0], -s[2])):
        if a < at:
            if b > at:  # overlapping spans: what is left of the later one goes too
                at = b
            continue
        out.append(text[at:a])
        word = text[a:b]
        out.append(f"[{KINDS[k].upper()}]" if k < 4 else "[NUMBER]" if any(c.isdigit() for c in word) else "[NAME]" if word[0].isupper() else "")
        at = b
    out.append(text[at:])
    return "".join(out)


def _found_in(column: pa.Array, told: np.ndarray | None, own: list | None) -> list[list[tuple[int, int, int]]]:
    """All spans of each text; told: disclosing terms, sorted; own: those of each text, instead."""
    texts = column.to_pylist()
    out = [base_spans(x) if x else [] for x in texts]
    if told is not None and len(told) or own is not None and any(own):
        h, doc, start, end = terms_of(column)
        if own is None:
            hit = find(told, h)[1]
        else:
            pairs = {(i, t) for i, known in enumerate(own) for t in known or ()}
            hit = np.array([p in pairs for p in zip(doc.tolist(), h.view(np.int64).tolist())], dtype=bool)
        doc, start, end = doc[hit], start[hit], end[hit]
        edge = np.searchsorted(doc, np.arange(len(texts) + 1))
        for i in np.flatnonzero(np.diff(edge)):
            a, b = start[edge[i] : edge[i + 1]], end[edge[i] : edge[i + 1]]
            free = ~_overlapping(a, b, out[i])
            out[i] = sorted(out[i] + [(int(x), 4, int(y)) for x, y in zip(a[free], b[free])])
    return out


def scan(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, min_support: int = MIN_SUPPORT, clean: bool = True, max_terms: int | None = None) -> tuple[DataFrame, str]:
    """docs and a struct column (its name is returned): spans (kind, start, end) by start, then kind; clean, the sanitised text."""
    spark, most = docs.sparkSession, MAX_TERMS if max_terms is None else max_terms
    small_batches(spark)
    with freeing_shuffles(spark):
        terms = written(disclosing(docs, text, threshold, min_support, max_terms=most).select("term").distinct(), "disclosing")
        n_terms = terms.count()
    name = fresh(docs.columns, "pii")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, _FOUND)])
    if n_terms <= most:
        source, column, shipped = docs, None, spark.sparkContext.broadcast(_sorted_terms(terms))
    else:
        # Each distinct text fetches the disclosing ones of its terms.
        texts = docs.select(F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).where("text IS NOT NULL").mapInArrow(_distinct_terms, _TERMS)
        hits = texts.select("text_hash", F.explode("terms").alias("term")).join(terms, "term")
        column, key = fresh([*docs.columns, name], "told"), fresh(docs.columns, "key")
        own = hits.groupBy(F.col("text_hash").alias(key)).agg(F.collect_set("term").alias(column))
        source = docs.withColumn(key, F.xxhash64(text)).join(own, key, "left").select(*docs.columns, column)
        shipped = spark.sparkContext.broadcast(None)

    keep = list(docs.columns)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, text, PIECE):
                texts = piece.column(piece.schema.get_field_index(text))
                own = piece.column(piece.schema.get_field_index(column)).to_pylist() if column else None
                found = _found_in(texts, shipped.value, own)
                spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in s] for s in found]
                cleaned = [generalise(x, s) if s else x for x, s in zip(texts.to_pylist(), found)] if clean else [None] * len(found)
                made = pa.StructArray.from_arrays([pa.array(spans, _SPAN_ARROW), pa.array(cleaned, pa.string())], names=["spans", "clean"])
                yield pa.RecordBatch.from_arrays([*[piece.column(k) for k in range(len(keep))], made], names=[*keep, name])

    return source.mapInArrow(run, schema), name


def sanitise(docs: DataFrame, text: str = "text", length: str | None = None, **options) -> DataFrame:
    """docs with the sanitised text; length names a column of code points to set anew."""
    found, name = scan(docs, text, **options)
    out = found.withColumn(text, F.col(name)["clean"]).drop(name)
    return out.withColumn(length, F.length(text).cast(docs.schema[length].dataType)) if length else out
