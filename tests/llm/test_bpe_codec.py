"""BPE ids against the public library's, and its decoding."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe_codec as B
from tidemark.llm import registry

from .conftest import ODD

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

SIGNS = " \n\t　 \x1c\x85abcABC'sStTmdlvre0123..,!é😀ſ中國"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public.path(B.VOCABULARY))


@pytest.fixture(scope="module")
def own():
    parts = B.load()
    return B.Encoder(B.Vocabulary(*parts)), B.spelling(parts)


def texts():
    rng = random.Random(7)
    out = ["", " ", "  a", "don't we'll I'Ve", "<|endoftext|>", "a <|endoftext|>  b<|endoftext|><|endoftext|> <|endoftext|", "x" * 100_000, "ab" * 5_000 + "  c", " " * 4_000 + "a\n\n b"]
    out += ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    out += ["".join(rng.choice(a) for _ in range(rng.randint(0, 80))) for a in ("ab", "aA'", "etaoin sh", "é ", "0 1") for _ in range(300)]
    out += ["".join(chr(c) for c in (rng.randrange(0x110000) for _ in range(30)) if not 0xD800 <= c < 0xE000) for _ in range(1000)]
    return out


def test_ids_and_texts_equal_the_library_s(own, library):
    encoder, table = own
    for x, want in zip(texts(), library.encode_batch(texts(), add_special_tokens=False)):
        got = np.frombuffer(encoder.encode(x), "<u4").tolist()
        assert got == want.ids, x[:100]
        assert B.decode(got, table) == library.decode(want.ids, skip_special_tokens=False) == x


def test_runs_of_every_code_point(library):
    pattern, before = B.runs_pattern(), tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = "".join(f"a{chr(c)}1{chr(c)}! {chr(c)}\n" for c in points[at : at + 4096])
        assert pattern.findall(text) == [text[a:b] for _, (a, b) in before.pre_tokenize_str(text)]


def test_pieces_stand_together_as_merging_says(own):
    """The test of two neighbours against merging the bytes of both, the lowest rank first."""
    v, rng = own[0].v, random.Random(3)
    by_byte = {b: i for i, b in v.names.items() if len(b) == 1}

    def merged(raw):
        ids = [by_byte[bytes([b])] for b in raw]
        while True:
            ranked = [(v.rank[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in v.rank]
            if not ranked:
                return ids
            k = min(ranked)[1]
            piece = next(i for i, p in by_parts[ids[k], ids[k + 1]])
            ids[k : k + 2] = [piece]

    by_parts = {p: [(i, p)] for i, p in v.parts.items()}
    pieces = sorted(v.names)
    for _ in range(3000):
        a, b = rng.choice(pieces), rng.choice(pieces[:2000])
        assert v.follows(a, b) == (merged(v.names[a] + v.names[b]) == [a, b])


def test_windows_change_nothing(own, monkeypatch):
    encoder = own[0]
    rng = random.Random(5)
    long = "".join(rng.choice(SIGNS + "    ") for _ in range(20_000))
    whole = encoder.encode(long)
    monkeypatch.setattr(B, "WINDOW", 64)
    assert encoder.encode(long) == whole


def test_small_caches_change_nothing(own, monkeypatch):
    want = [own[0].encode(x) for x in texts()[:1500]]
    for name, n in (("CACHE", 5), ("PAIRS", 5), ("RUN", 2)):
        monkeypatch.setattr(B, name, n)
    few = B.Encoder(own[0].v)
    few.v._known.clear()
    assert [few.encode(x) for x in texts()[:1500]] == want


def test_a_file_of_another_kind_is_refused(tmp_path):
    with pytest.raises(ValueError, match="byte-level"):
        B.load(public.path("word_bpe_49k.json"))
    names = {i: bytes([i]) for i in range(256)} | {256: b"ab", 257: b"abc", 258: b"bc"}
    with pytest.raises(ValueError, match="makes no piece"):
        B.Vocabulary(names, [(97, 98), (98, 99), (256, 99), (97, 258)], {})
    with pytest.raises(ValueError, match="later merges"):
        B.Vocabulary(names, [(256, 99), (97, 98)], {})
    # A piece that merging never leaves whole is no candidate: bc is merged before ab.
    v = B.Vocabulary(names, [(98, 99), (97, 98), (256, 99)], {})
    assert 257 not in v.whole and {256, 258} <= v.whole
    assert np.frombuffer(B.Encoder(v).encode("abc"), "<u4").tolist() == [97, 258]


def test_odd_rows_and_clashing_columns(make, library):
    docs = make(ODD, clash=True).withColumn("IDS", F.lit("mine"))
    coded, ids = B.encode(docs)
    packed, raw = B.encode(docs, packed=True)
    back, text = B.decoded(coded, ids, name="text")
    assert ids not in docs.columns and text not in coded.columns and coded.columns[:-1] == docs.columns
    want = sorted((str(i), None if x is None else library.encode(x, add_special_tokens=False).ids, x) for i, x in ODD)
    assert sorted(((str(r["doc_id"]), r[ids], r[text]) for r in back.collect()), key=str) == sorted(want, key=str)
    again, text = B.decoded(packed, raw)
    assert sorted(str((r["doc_id"], r[text])) for r in again.collect()) == sorted(str((i, x)) for i, x in ODD)
    assert B.encode(make([]))[0].count() == 0


def test_query_digests(spark, tmp_path, make, library):
    rows = [*ODD, (20, "a<|endoftext|> b")]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op11_bpe"](spark, str(tmp_path)).collect()
    want = []
    for i, x in rows:
        ids = library.encode(x or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_query_on_tables(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = registry.QUERIES["op11_bpe"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        ids = np.array(library.encode(docs[r["doc_id"]], add_special_tokens=False).ids, "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())


def test_an_encoder_is_kept_for_the_next_task(own):
    parts = B.load()
    first = B._encoder(parts)
    first.encode("some text")
    assert B._encoder(parts) is first and "text" in first.known and not first.runs_known.get(" text")
    assert B._encoder(B.load()) is not first


def test_texts_come_back_with_the_ids(make, own):
    docs = make(ODD, clash=True)
    both, ids = B.encode(docs, packed=True, back="back")
    apart, _ = B.decoded(B.encode(docs, packed=True)[0], ids, name="back")
    want = [(str(r["doc_id"]), r[ids], r["back"]) for r in apart.collect()]
    assert sorted(((str(r["doc_id"]), r[ids], r["back"]) for r in both.collect()), key=str) == sorted(want, key=str)
    table = own[1]
    rows = [[5, 10**6, 7], [], [table.index(b"\xc3")], [table.index(b"\xc3"), table.index(b"\xa9")], [2**32 - 1]]
    flat, ends = np.array([i for x in rows for i in x]), np.cumsum([0, *map(len, rows)])
    got = B._texts(flat, ends, np.array([False, True, False, False, False]), B._table(table)).to_pylist()
    assert got == [B.decode(rows[0], table), None, "\ufffd", "\u00e9", ""]
