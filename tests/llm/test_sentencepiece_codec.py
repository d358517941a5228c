import os
import random

import numpy as np
import pytest

from tidemark.llm import sentencepiece_codec as S

from .conftest import ODD, prose

pytestmark = pytest.mark.skipif(not os.path.exists(S.MODEL), reason="no public vocabulary file here")


@pytest.fixture(scope="module")
def vocabulary():
    return S.load()


def brute(text, v):
    """The greatest sum of scores over all cuts, in quadratic time."""
    t = " " + text
    u = [None if c == S.SPACE else S.SPACE if c == " " else c for c in t]
    best = [0.0] + [-1e300] * len(t)
    for j in range(1, len(t) + 1):
        c = t[j - 1]
        best[j] = best[j - 1] + v.byte_score * (1 if c == " " else len(c.encode()))
        for i in range(max(0, j - v.longest), j):
            if None not in u[i:j] and (f := v.scored.get("".join(u[i:j]))):
                best[j] = max(best[j], best[i] + f[1])
    return best[-1]


def total(ids, v):
    score = {i: s for i, s in v.scored.values()}
    return sum(score.get(i, v.byte_score) for i in ids)


def samples():
    rng = random.Random(2)
    bits = ["the ", " ", "  ", "ing", "é", "a", "xq", "\n", S.SPACE, "你", "0", "😀", "tion", "zzzz", "\u0000", "\ue000", "\t"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(400)] + ["x", " ", "a" * 300, "internationalization" * 20]


def test_round_trip_and_best_score(vocabulary):
    e = S.Encoder(vocabulary)
    for x in samples():
        ids = np.frombuffer(e.encode(x), "<i4").tolist()
        assert S.decode(ids, vocabulary) == x
        assert total(ids, vocabulary) == pytest.approx(brute(x, vocabulary))


def whole(text, v):
    """All boundaries kept to the end; of equal sums the cut whose last piece is longer."""
    best, back = [0.0], [None]
    for j in range(1, len(text) + 1):
        found = (-1e300, None)
        for i in range(max(0, j - v.longest), j):
            piece = v.scored.get(text[i:j])
            if piece and best[i] + piece[1] > found[0]:
                found = (best[i] + piece[1], (i, [piece[0]]))
        c = text[j - 1]
        raw = b" " if c == S.SPACE else c.encode()
        if c not in v.single and best[j - 1] + v.byte_score * len(raw) > found[0]:
            found = (best[j - 1] + v.byte_score * len(raw), (j - 1, [v.byte_ids[b] for b in raw]))
        best.append(found[0])
        back.append(found[1])
    out, at = [], len(text)
    while at:
        at, ids = back[at]
        out = ids + out
    return out


def test_streaming_equals_one_window(vocabulary):
    for x in samples():
        plain = (" " + x).replace(" ", S.SPACE)
        assert list(S.stream(plain, vocabulary)) == whole(plain, vocabulary)


def test_streaming_where_paths_meet_late():
    """Pieces of a's alone, in two phases of which the end decides: no boundary is certain for a long way."""
    v = S.Vocabulary({"aa": (0, -1.0), "a": (1, -1.2), "aab": (2, -0.1), "aaab": (3, -3.0)}, list(range(10, 266)), 300)
    for n in [*range(1, 60), 1000, 1001]:
        for tail in ("", "b", "bz"):
            assert list(S.stream("a" * n + tail, v)) == whole("a" * n + tail, v)


def test_encoder_equals_the_stream_over_the_whole_text(vocabulary):
    """What is remembered between boundaries that no piece crosses is what the window commits there."""
    for x in samples():
        if S.SPACE not in x:
            e = S.Encoder(vocabulary)
            assert np.frombuffer(e.encode(x), "<i4").tolist() == list(S.stream((" " + x).replace(" ", S.SPACE), vocabulary))


def test_stream_commits_before_the_end(vocabulary):
    seen = []

    class Watched(str):
        def __getitem__(self, k):
            seen.append(k if isinstance(k, int) else k.stop)
            return str.__getitem__(self, k)

    first = next(S.stream(Watched("abcdefgh" * 2000), vocabulary))
    assert isinstance(first, int) and max(seen) < 1000


def test_frame(make, vocabulary):
    docs = make(ODD, clash=True)
    out, name = S.encode(docs)
    rows = out.collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r[name]["ids"] is None) == (r["text"] is None) and r[name]["round_trip"] in (True, None)
    back = S.decoded(out.select("doc_id", "text", f"{name}.ids"))
    assert all(r["decoded"] == r["text"] for r in back.collect())
    assert S.encode(make([]))[0].count() == 0


def test_unknown_ids_decode_to_nothing(vocabulary):
    assert S.decode([0, 1, 2, 10**6, -1], vocabulary) == ""


def test_a_run_is_one_window(vocabulary, monkeypatch):
    """A run shorter than two thirds of the window commits once; a run seen before in the text or the task not at all."""
    calls, real = [], S._path
    monkeypatch.setattr(S, "_path", lambda text, *a: calls.append(text) or real(text, *a))
    e, text = S.Encoder(vocabulary), "qzx zzqk! vwxq qzx zzqk! qzx"
    for _ in range(2):
        assert S.decode(np.frombuffer(e.encode(text), "<i4").tolist(), vocabulary) == text
    assert len(calls) == len(set(calls)) == len({r for r in e.known})
