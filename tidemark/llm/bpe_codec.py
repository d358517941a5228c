"""BPE encoding and decoding by dynamic programming over prefixes.

A vocabulary of merges cuts each run of a text into the pieces that merging the lowest-ranked pair again and again would
leave. No pair is ever merged here. Every prefix of a run has exactly one last piece, namely the one that (1) ends the
prefix and (2) stands well after the last piece of what comes before it: merging the bytes of the two from scratch gives
the two again. A suffix-matching automaton over the vocabulary names the pieces that end at each byte, the longest first;
the first that passes the test is stored, and back-pointers from the end give the ids. Time grows linearly with the run.

The test needs no merging either. A piece's right edge is the piece, its right part, that one's right part and so on, each
of which exists until the merge that takes it into the next larger one; its left edge likewise. Two pieces stand well
together unless a merge joins some x of the first's right edge to some y of the second's left edge while both exist.

Runs are those of the byte-level scheme: a contraction, an optional space with letters, with numbers or with other signs,
or white space. A run always begins at a space before something that is no white space, so a text is cut there in windows
of WINDOW characters, and each worker process remembers the ids of up to 2 CACHE such stretches and runs of at most RUN characters, from
one task to the next. Memory is bounded by these, by the longest run and by the ids of the text at hand.

Special tokens of the file stand in texts as themselves: their strings become their ids and part the text.

Defined cases: a null text gives null ids, an empty text none; unknown ids decode to nothing, invalid byte sequences to
U+FFFD; equal rows are encoded alike; an empty table gives an empty result; other columns pass through unchanged, whatever
their names. Texts are encoded whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import each_piece, fresh

VOCABULARY = "byte_bpe_50k.json"
CACHE = 600_000
PAIRS = 2_000_000
RUN = 64
WINDOW = 1 << 20
#: Bytes of ids that are decoded at a time.
DECODED = 1 << 20

#: White space of the byte-level scheme.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and numbers that Unicode 16, which the scheme follows, has beyond Unicode 15.1.
LETTERS_16 = (
    r"\u1c89-\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85\U00010ec2-\U00010ec4"
    r"\U00011380-\U00011389\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1\U000113d3\U00011bc0-\U00011be0"
    r"\U00013460-\U000143fa\U00016100-\U0001611d\U00016d40-\U00016d6c\U00018cff\U0001e5d0-\U0001e5ed\U0001e5f0"
)
NUMBERS_16 = r"\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016130-\U00016139\U00016d70-\U00016d79\U0001ccf0-\U0001ccf9\U0001e5f1-\U0001e5fa"


def _ranges(kind: str) -> str:
    """The code points of a general category's first letter, as they stand in a character class."""
    out: list[list[int]] = []
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == kind:
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in out)


def runs_pattern() -> re.Pattern:
    letter, number = _ranges("L") + LETTERS_16, _ranges("N") + NUMBERS_16
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{WHITE}{letter}{number}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


#: A run begins here, whatever stands around it.
_CUT = re.compile(r" (?=\S)")


def byte_signs() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)]


class Vocabulary:
    """Pieces by id as bytes, merges in rank order, special tokens. Its size is that of the file."""

    def __init__(self, names: dict[int, bytes], merges: list[tuple[int, int]], special: dict[str, int]):
        self.names, self.merges, self.special = names, merges, special
        by_name = {b: i for i, b in names.items()}
        self.rank, self.parts, self.made = {}, {}, {}
        for rank, (a, b) in enumerate(merges):
            piece = by_name.get(names[a] + names[b])
            if piece is None or piece in self.parts or len(names[piece]) == 1:
                raise ValueError(f"merge {rank} makes no piece, or one that another merge makes")
            if any(len(names[x]) > 1 and x not in self.parts for x in (a, b)):
                raise ValueError(f"merge {rank} joins pieces that later merges make")
            self.rank[a, b], self.parts[piece], self.made[piece] = rank, (a, b), rank
        single = {b for b in names.values() if len(b) == 1}
        if len(single) != 256:
            raise ValueError("the vocabulary lacks single bytes: texts could not be given back")
        never = len(merges)
        self._edges: tuple[dict, dict] = {}, {}
        self.whole = {i for i, b in names.items() if len(b) == 1}
        for piece, (a, b) in self.parts.items():  # in rank order, so parts are known
            if a in self.whole and b in self.whole and not self._joined(a, b, self.made[piece]):
                self.whole.add(piece)
        self._never, self._known = never, {}

    def _edge(self, piece: int, side: int) -> list[tuple[int, int]]:
        """The pieces along one edge (0 left, 1 right), each with the rank of the merge that takes it into a larger one."""
        got = self._edges[side].get(piece)
        if got is None:
            got, gone, at = [], len(self.merges), piece
            while True:
                got.append((at, gone))
                if at not in self.parts:
                    break
                gone, at = self.made[at], self.parts[at][side]
            self._edges[side][piece] = got
        return got

    def _joined(self, a: int, b: int, limit: int) -> bool:
        """Whether a merge of a rank below limit joins some end of a to some beginning of b.

        Of equal merges the leftmost is first: one that takes x into its left neighbour is before, one that takes y into
        its right neighbour after that of x and y."""
        rank, right = self.rank, self._edge(b, 0)
        for x, x_gone in self._edge(a, 1):
            for y, y_gone in right:
                r = rank.get((x, y))
                if r is not None and r < limit and r < x_gone and r <= y_gone:
                    return True
        return False

    def follows(self, a: int, b: int) -> bool:
        """Whether b stands well after a."""
        key = (a, b)
        got = self._known.get(key)
        if got is None:
            if len(self._known) >= PAIRS:
                self._known.clear()
            got = self._known[key] = not self._joined(a, b, self._never)
        return got


def load(path: str | None = None) -> tuple[dict[int, bytes], list[tuple[int, int]], dict[str, int]]:
    """Names, merges and special tokens of a byte-level tokenizer file. The file is read on the driver alone."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, before = file["model"], file["pre_tokenizer"] or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model["type"] != "BPE" or file["normalizer"] or not plain or odd:
        raise ValueError(f"{path} is not a plain byte-level BPE file: {odd}")
    byte_of = {s: b for b, s in enumerate(byte_signs())}
    added = {x["content"]: x["id"] for x in file["added_tokens"]}
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in file["added_tokens"]):
        raise ValueError(f"{path} has special tokens that take white space or stand as words only")
    vocab = model["vocab"]
    names = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items() if s not in added}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return names, [(vocab[a], vocab[b]) for a, b in merges], added


class Encoder:
    def __init__(self, v: Vocabulary):
        import ahocorasick

        self.v, self.known, self.runs_known = v, {}, {}
        self.size = {i: len(v.names[i]) for i in v.whole}
        # A run that is a piece: the longest that ends it begins it.
        self.alone = {v.names[i]: array("I", [i]) for i in v.whole}
        self.ends = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i in v.whole:
            self.ends.add_word(v.names[i].decode("latin-1"), i)
        self.ends.make_automaton()
        self.runs = runs_pattern()
        strings = sorted(v.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, strings)) + ")") if strings else None

    def piece_ids(self, raw: bytes) -> array:
        """Ids of one run: the last piece of every prefix, then the way back from the end."""
        one = self.alone.get(raw)
        if one is not None:
            return one
        size, follows, known = self.size, self.v.follows, self.v._known.get
        last = [-1] * (len(raw) + 1)
        for end, piece in self.ends.iter(raw.decode("latin-1")):
            end += 1
            if last[end] < 0:
                begin = end - size[piece]
                if begin == 0:
                    last[end] = piece
                else:
                    before = last[begin]
                    good = known((before, piece))
                    if good or good is None and follows(before, piece):
                        last[end] = piece
        out, at = array("I"), len(raw)
        while at:
            out.append(last[at])
            at -= size[last[at]]
        out.reverse()
        return out

    def _run(self, run: str) -> bytes:
        """Ids of one run. One that begins with a space is remembered as what follows it, as a stretch of it alone is."""
        known, key = (self.known, run[1:]) if run[0] == " " else (self.runs_known, run)
        got = known.get(key)
        if got is None:
            got = self.piece_ids(run.encode()).tobytes()
            if len(run) <= RUN:
                self._keep(known, key, got)
        return got

    def _keep(self, known: dict, key: str, got: bytes) -> None:
        if len(self.known) + len(self.runs_known) >= 2 * CACHE:
            self.known.clear()
            self.runs_known.clear()
        known[key] = got

    def _stretch(self, text: str) -> bytes:
        return b"".join(map(self._run, self.runs.findall(text)))

    def _after_space(self, text: str) -> bytes:
        """Ids of a space and what follows it up to the next certain cut."""
        if text.isalpha():
            return self._run(" " + text)
        got = self._stretch(" " + text)
        if len(text) <= RUN:
            self._keep(self.known, text, got)
        return got

    def _plain(self, text: str) -> bytes:
        out, at, n, known = [], 0, len(text), self.known
        while at < n:
            cut = _CUT.search(text, at + WINDOW) if n - at > WINDOW else None
            end = cut.start() if cut else n
            first, *rest = _CUT.split(text[at:end])
            if first:
                out.append(self._stretch(first))
            found = list(map(known.get, rest))
            if None in found:
                found = [self._after_space(x) if got is None else got for x, got in zip(rest, found)]
            out += found
            at = end
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out = []
        for k, x in enumerate(self.special.split(text)):
            out.append(array("I", [self.v.special[x]]).tobytes() if k % 2 else self._plain(x))
        return b"".join(out)


def spelling(parts) -> list[bytes]:
    """What each id decodes to."""
    names, _, special = parts
    out = [b""] * (1 + max([*names, *special.values()]))
    for i, b in [*names.items(), *((i, s.encode()) for s, i in special.items())]:
        out[i] = b
    return out


def decode(ids, table: list[bytes]) -> str:
    n = len(table)
    return b"".join([table[i] if 0 <= i < n else b"" for i in ids]).decode("utf-8", "replace")


_kept: list = []


def _encoder(parts) -> Encoder:
    """The encoder of these parts, kept by the worker process for its next tasks."""
    if not _kept or _kept[0] is not parts:
        _kept[:] = parts, Encoder(Vocabulary(*parts))
    return _kept[1]


def _texts(ids: np.ndarray, ends: np.ndarray, null: np.ndarray, table: pa.BinaryArray) -> pa.Array:
    """Texts of rows whose ids end at those places; the last entry of the table is empty and stands for unknown ids."""
    known = np.where((ids >= 0) & (ids < len(table) - 1), ids, len(table) - 1)
    spelt = table.take(pa.array(known))
    data = spelt.buffers()[2]
    at = np.frombuffer(spelt.buffers()[1], np.int64, len(known) + 1)[ends]
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(at)), data])
    raw = pc.if_else(pa.array(null), None, raw) if null.any() else raw
    try:
        return raw.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are no UTF-8
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def _table(spellings: list[bytes]) -> pa.Array:
    return pa.array([*spellings, b""], pa.large_binary())


def encode(docs: DataFrame, text: str = "text", path: str | None = None, packed: bool = False, back: str | None = None) -> tuple[DataFrame, str]:
    """docs and a column (its name is returned) with the ids of each text: an array of integers, or packed as
    little-endian unsigned 32-bit integers in one binary value. A name in back replaces the text by what the ids decode to."""
    name, parts = fresh(docs.columns, "ids"), load(path)
    shipped = docs.sparkSession.sparkContext.broadcast(parts)
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    place = docs.columns.index(text)
    fields = [*docs.schema.fields]
    if back is not None:
        fields[place] = T.StructField(back, T.StringType())
    schema = T.StructType([*fields, T.StructField(name, kind)])

    def run(batches):
        encoder, table = _encoder(shipped.value), None if back is None else _table(spelling(shipped.value))
        for piece in each_piece(batches, text):
            coded = [None if x is None else encoder.encode(x) for x in piece.column(place).to_pylist()]
            columns = [*piece.columns]
            sizes = [0, *accumulate(len(x or b"") // 4 for x in coded)]
            if packed:
                made = pa.array(coded, pa.binary())
            else:
                ends = pa.array([None if k < len(coded) and coded[k] is None else e for k, e in enumerate(sizes)], pa.int32())
                made = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(x or b"" for x in coded), "<i4")))
            if back is not None:
                null = np.array([x is None for x in coded], bool)
                columns[place] = _texts(np.frombuffer(b"".join(x or b"" for x in coded), "<u4").astype(np.int64), np.array(sizes), null, table)
            yield pa.RecordBatch.from_arrays([*columns, made], names=[f.name for f in fields] + [name])

    return docs.mapInArrow(run, schema), name


def decoded(rows: DataFrame, ids: str = "ids", path: str | None = None, name: str = "decoded") -> tuple[DataFrame, str]:
    """rows and one more column (its name is returned): the text of their ids, which may be packed. Null ids give null."""
    name, packed = fresh(rows.columns, name), isinstance(rows.schema[ids].dataType, T.BinaryType)
    shipped = rows.sparkSession.sparkContext.broadcast(spelling(load(path)))
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])

    def run(batches):
        spellings = shipped.value
        table = _table(spellings)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            sizes = np.cumsum(pc.fill_null(pc.binary_length(column) if packed else pc.multiply(pc.list_value_length(column), 4), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(sizes):
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + DECODED, side="right")))
                part = batch.slice(at, end - at)
                values = part.column(batch.schema.get_field_index(ids))
                if packed:
                    raw, null = values.to_pylist(), pc.is_null(values).to_numpy(zero_copy_only=False)
                    places = np.array([0, *accumulate(len(x or b"") // 4 for x in raw)])
                    texts = _texts(np.frombuffer(b"".join(x or b"" for x in raw), "<u4").astype(np.int64), places, null, table)
                else:
                    texts = pa.array([None if x is None else decode(x, spellings) for x in values.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, name])
                at = end

    return rows.mapInArrow(run, schema), name
