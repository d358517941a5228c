"""SentencePiece encoding and decoding by streaming Viterbi.

A text, with a space put before it and spaces written as U+2581, is cut into pieces of a given vocabulary so that the
sum of their scores is greatest; of equal sums, the cut whose last piece is longer. What no piece spells goes as UTF-8
byte pieces at a score below every piece's. Decoding gives the text back exactly: a U+2581 of the text itself goes as
bytes too.

The Viterbi window holds a few times max_piece positions. Whenever all of its surviving backpointer paths meet in one
boundary, the ids up to there are committed and forgotten, so memory is bounded by the window and by what is committed.
Each time two thirds of it are filled, the window looks for the boundary where they meet: its end, if no piece reaches
beyond, or one before. Boundaries that no piece of the vocabulary crosses (mostly those of words) are known beforehand: all paths meet
there, so what was committed between two of them is the same wherever it stands, and each task remembers it for up to
CACHE such runs of at most RUN characters.

Defined cases: a null text gives null ids, an empty text none; unknown ids decode to nothing, control pieces too;
invalid byte sequences decode to U+FFFD; equal rows are encoded alike; an empty table gives an empty result; other
columns pass through unchanged. Texts are encoded whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import fresh
from .shared import small_batches
from .tokens import pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CACHE = 600_000
RUN = 64
#: How far a byte piece's score lies below the least score of a piece.
BYTE_PENALTY = 10.0


_NEVER = -1e300


class Vocabulary:
    """Pieces with ids and scores, byte pieces, and what decodes to nothing. Its size is that of the model file."""

    def __init__(self, scored: dict[str, tuple[int, float]], byte_ids: list[int], size: int):
        # Models give user-defined pieces (here runs of spaces) a score of no meaning; they count as the least ordinary one.
        least = min((s for _, s in scored.values() if s > -1e8), default=0.0)
        self.scored = {p: (i, s if s > -1e8 else least) for p, (i, s) in scored.items() if p}
        self.byte_ids, self.size = byte_ids, size
        self.longest = max(map(len, self.scored), default=1)
        self.byte_score = least - BYTE_PENALTY
        self.single = {p for p in self.scored if len(p) == 1}
        # Pieces by character, each node a dict of the nodes after it, with the id (-1: no piece) and score of what it spells.
        top: list = [{}, -1, 0.0]
        for p, (i, score) in self.scored.items():
            node = top
            for c in p:
                node = node[0].setdefault(c, [{}, -1, 0.0])
            node[1:] = i, score
        self.trie: dict = top[0]
        # A cut may always be made before a space mark that follows another character, and around characters that no
        # piece joins to others, if the vocabulary has no piece across it.
        self.marks_lead = all(SPACE not in p.lstrip(SPACE) for p in self.scored)
        self.newline_alone = not any("\n" in p and len(p) > 1 for p in self.scored)
        self.bytes_of = [b""] * size
        for p, (i, _) in self.scored.items():
            self.bytes_of[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(byte_ids):
            self.bytes_of[i] = bytes([b])

    def parts(self) -> tuple:
        """Plain data to make it again from."""
        return self.scored, self.byte_ids, self.size


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    size = m.get_piece_size()
    plain = [i for i in range(size) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    byte_ids = sorted((i for i in range(size) if m.is_byte(i)), key=lambda i: int(m.id_to_piece(i)[1:-1], 16))
    if len(byte_ids) != 256:
        raise ValueError(f"{path} has no byte pieces: texts could not be given back")
    return Vocabulary({m.id_to_piece(i): (i, m.get_score(i)) for i in plain}, byte_ids, size)


def stream(text: str, v: Vocabulary):
    """Ids of a normalised text, committed where they are certain whenever the window has filled, and at the end."""
    n, longest, root, byte_score, single = len(text), v.longest, v.trie, v.byte_score, v.single
    # For each boundary of the window, from the last committed one: best sum, start of the last piece, its id (None: bytes).
    full, size = 2 * longest, min(n, 3 * longest) + 1
    best, back, ids = [_NEVER] * size, [0] * size, [None] * size
    best[0] = 0.0
    done, at, far = 0, 0, 0
    for begin in range(n):
        here, c, end, inner = best[at], text[begin], at, root
        # A piece of this one character, if there is one, scores above its bytes.
        if c not in single and (total := here + byte_score * (1 if c == SPACE else len(c.encode()))) > best[at + 1]:
            best[at + 1], back[at + 1], ids[at + 1] = total, at, None
        for x in text[begin : begin + longest]:
            if (node := inner.get(x)) is None:
                break
            end += 1
            inner, found, score = node
            if found >= 0 and (total := here + score) > best[end]:
                best[end], back[end], ids[end] = total, at, found
                if end > far:
                    far = end
        at += 1
        if begin + 1 == n:
            yield from _path(text, v, done, back, ids, at)
            return
        if at < full:
            continue
        if far <= at:
            meet = far = at
        else:
            # Paths that can still win go through this boundary or come from before it to those reached ahead.
            alive = {back[k] for k in range(at + 1, far + 1) if best[k] > _NEVER} | {at}
            while len(alive) > 1:
                last = max(alive)
                alive.discard(last)
                alive.add(back[last])
            meet = alive.pop()
        if not meet:
            more = at + longest + 1 - len(best)
            if more > 0:
                best, back, ids = best + [_NEVER] * more, back + [0] * more, ids + [None] * more
        else:
            yield from _path(text, v, done, back, ids, meet)
            done, at, far = done + meet, at - meet, far - meet
            best, back, ids = best[meet:] + [_NEVER] * meet, [k - meet for k in back[meet:]] + [0] * meet, ids[meet:] + [None] * meet


def _path(text: str, v: Vocabulary, done: int, back: list, ids: list, at: int) -> list[int]:
    """Ids of the best path from the window's first boundary, at the text's position done, to boundary at."""
    out = []
    while at > 0:
        begin = back[at]
        if ids[at] is None:
            c = text[done + begin]
            out += [v.byte_ids[b] for b in reversed(b" " if c == SPACE else c.encode())]
        else:
            out.append(ids[at])
        at = begin
    out.reverse()
    return out


class Encoder:
    def __init__(self, v: Vocabulary):
        self.v, self.known = v, {}
        line = r"\n|" if v.newline_alone else ""
        rest = r"[^▁\n]" if v.newline_alone else r"[^▁]"
        self.runs = re.compile(f"{line}▁+{rest}*|{rest}+".replace("\\u2581", SPACE)) if v.marks_lead else re.compile(r"(?s).+")

    def encode(self, text: str) -> bytes:
        """Ids as little-endian int32."""
        if not text:
            return b""
        plain = " " + text
        if SPACE in plain:
            return self._escaped(plain)
        return self._runs(plain.replace(" ", SPACE))

    def _runs(self, text: str) -> bytes:
        known, runs = self.known, self.runs.findall(text)
        out = list(map(known.get, runs))
        for k, got in enumerate(out):
            if got is None:
                run = runs[k]
                out[k] = got = known.get(run) or array("i", stream(run, self.v)).tobytes()  # known: from earlier in this text
                if len(run) <= RUN and run not in known:
                    if len(known) >= CACHE:
                        known.clear()
                    known[run] = got
        return b"".join(out)

    def _escaped(self, plain: str) -> bytes:
        """A space mark of the text itself goes as bytes: no piece may hold it, so the text is cut around it."""
        mark = np.array([self.v.byte_ids[b] for b in SPACE.encode()], "<i4").tobytes()
        return mark.join(self._runs(part.replace(" ", SPACE)) for part in plain.split(SPACE))


def decode(ids, v: Vocabulary) -> str:
    """The text of ids; the one space that encoding put first goes."""
    raw = b"".join([v.bytes_of[i] if 0 <= i < v.size else b"" for i in ids])
    return raw.removeprefix(b" ").decode("utf-8", "replace")


_ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, check: bool = True) -> tuple[DataFrame, str]:
    """docs and a struct column (its name is returned): ids, and whether decoding them gives the text back."""
    spark, name = docs.sparkSession, fresh(docs.columns, "encoded")
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(load(model).parts())
    schema = T.StructType([*docs.schema.fields, T.StructField(name, _ENCODED)])

    def run(batches):
        v = Vocabulary(*shipped.value)
        encoder = Encoder(v)
        for batch in batches:
            for piece in pieces(batch, text):
                texts = piece.column(piece.schema.get_field_index(text)).to_pylist()
                coded = [None if x is None else encoder.encode(x) for x in texts]
                sizes = np.array([0, *(len(x or b"") // 4 for x in coded)])
                flat = np.frombuffer(b"".join(x or b"" for x in coded), "<i4")
                nulls = np.array([x is None for x in texts], dtype=bool)
                offsets = pa.array(np.cumsum(sizes).astype(np.int32), mask=np.append(nulls, False)) if nulls.any() else pa.array(np.cumsum(sizes).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(flat))
                same = [None if c is None or not check else decode(np.frombuffer(c, "<i4").tolist(), v) == x for x, c in zip(texts, coded)]
                made = pa.StructArray.from_arrays([ids, pa.array(same, pa.bool_())], names=["ids", "round_trip"])
                yield pa.RecordBatch.from_arrays([*piece.columns, made], names=[*piece.schema.names, name])

    return docs.mapInArrow(run, schema), name


def decoded(rows: DataFrame, ids: str = "ids", model: str = MODEL, name: str = "decoded") -> DataFrame:
    """rows and one more column: the text of their ids."""
    shipped, name = rows.sparkSession.sparkContext.broadcast(load(model).parts()), fresh(rows.columns, name)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])

    def run(batches):
        v = Vocabulary(*shipped.value)
        for batch in batches:
            texts = [None if x is None else decode(x, v) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, schema)
