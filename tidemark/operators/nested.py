"""Walks of semi-structured values to any depth.

Documents are stored once, with whether they are plain: valid, and without numbers or escapes that a parser may read another
way. Plain ones are walked where they lie, each in one go, or as columns, if texts under a name are asked for. The others are parsed to VARIANT; a level's objects and arrays
are exploded into the next level until none is left, so they take as many steps as the deepest has levels, and every level
is a table. What one task holds is one document, and a bounded number of its values.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import temporary


def _kind(v: Column) -> Column:
    """object, array, string, number, boolean or null."""
    name = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    plain = F.when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").otherwise("number")
    return F.when(name == "OBJECT", "object").when(name == "ARRAY", "array").otherwise(plain)


#: Fractions, exponents and whole numbers beyond a long, and halves of surrogate pairs: their text is VARIANT's.
_ODD, _HALF = r"[0-9](?:[.eE]|[0-9]{18})", r"\\u[dD][89a-fA-F]"
#: Values up to which a task gathers what it hands on.
BATCH = 20_000
#: Documents a file of the stored table, so that many tasks walk them.
DEALT = 25_000
#: Characters of documents after which a task hands on what it found of their shapes, and parts that a shape's texts are dealt to.
GATHERED, BUCKETS = 1 << 22, 64
#: Characters of documents that are read as columns at a time, documents whose form is taken for that, fields that it may
#: have, and how often a task tries another form.
READ, LOOKED_AT, FIELDS, FORMS = 1 << 20, 50, 100, 3
_ROWS_A_FILE = "spark.sql.files.maxRecordsPerFile"


def _text(v) -> tuple[str, str | None]:
    """Kind and text of a parsed value."""
    kind = type(v)
    if kind is int:
        return "number", str(v)
    if kind is str:
        return "string", v
    if kind is dict:
        return "object", None
    if kind is list:
        return "array", None
    if v is None:
        return "null", None
    return "boolean", "true" if v else "false"


def _values(v, out: list[list], most: int):
    """Put path, name, depth, kind and text of every value in v into the lists of out; pause whenever they hold so many."""
    paths, names, depths, kinds, texts = out
    for column, x in zip(out, ("$", None, 0, *_text(v))):
        column.append(x)
    waiting = [("$", 1, v)] if type(v) in (dict, list) else []
    while waiting:
        path, depth, v = waiting.pop()
        named = type(v) is dict
        for k, x in v.items() if named else enumerate(v):
            at = f"{path}.{k}" if named else f"{path}[{k}]"
            if type(x) is dict or type(x) is list:
                waiting.append((at, depth + 1, x))
            kind, text = _text(x)
            paths.append(at)
            names.append(k if named else None)
            depths.append(depth)
            kinds.append(kind)
            texts.append(text)
            if len(paths) >= most:
                yield
    yield


def _named(v, name: str, ends: tuple[str, ...], out: list[list], most: int):
    """As _values, of the texts under one name that have one of those ends; a path is put together where it is wanted."""
    paths, names, depths, kinds, texts = out
    # A container waits with its path's beginning, its own step and that step's form.
    waiting = [("$", None, 1, v)]
    while waiting:
        path, step, depth, v = waiting.pop()
        kind = type(v)
        if kind is dict:
            at = path if step is None else f"{path}.{step}" if type(step) is str else f"{path}[{step}]"
            for k, x in v.items():
                kind = type(x)
                if kind is dict or kind is list:
                    if x:
                        waiting.append((at, k, depth + 1, x))
                elif k == name and x is not None:
                    text = x if kind is str else str(x) if kind is int else "true" if x else "false"
                    if text.endswith(ends):
                        paths.append(f"{at}.{k}")
                        names.append(k)
                        depths.append(depth)
                        kinds.append("string" if kind is str else "number" if kind is int else "boolean")
                        texts.append(text)
                        if len(paths) >= most:
                            yield
        elif kind is list:
            at = None
            for k, x in enumerate(v):
                if x and (type(x) is dict or type(x) is list):
                    if at is None:
                        at = path if step is None else f"{path}.{step}" if type(step) is str else f"{path}[{step}]"
                    waiting.append((at, k, depth + 1, x))
    yield


def _ends(pattern: str) -> tuple[str, ...]:
    """Ends of which any text with the pattern has one: plain signs before a final $ (which may stand before a line's end)."""
    if re.fullmatch(r"[A-Za-z0-9 _-]+\$", pattern):
        return (pattern[:-1], "\n", "\r", "\x85", "\u2028", "\u2029")
    return ("",)


def _stored(documents: DataFrame, key: str, doc: str) -> tuple[DataFrame, DataFrame]:
    """Plain documents and the other valid ones. All are written, with what they are, since a filter before would be pushed
    below the projection that makes them and make each once more."""
    half = F.col(doc).contains("\\u") & F.col(doc).rlike(_HALF)
    plain, conf = F.is_valid_utf8(doc) & ~F.col(doc).rlike(_ODD) & ~half, documents.sparkSession.conf
    state = F.when(F.try_parse_json(doc).isNull(), "invalid").when(plain, "plain").otherwise("other")
    old = conf.get(_ROWS_A_FILE)
    conf.set(_ROWS_A_FILE, DEALT)
    try:
        kept = temporary(documents.select(key, doc, state.alias("_state")), "documents")
    finally:
        conf.set(_ROWS_A_FILE, old)
    return kept.where("_state = 'plain'").drop("_state"), kept.where("_state = 'other'").drop("_state")


_WALKED = "path string, name string, depth int, kind string, value string"
_SHAPED = "shape string, kind string, bucket int, n long, depth int, texts array<string>"


def _parsed(texts: pa.Array, decode: Callable):
    for text in texts:
        text = text.as_py()
        yield len(text), decode(text.lstrip(" \t\n\r"))[0]


def _row_batch(key: str, *columns) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
    made = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, t) for x, t in zip(columns[1:], types)]
    return pa.RecordBatch.from_arrays([columns[0], *made], names=[key, "path", "name", "depth", "kind", "value"])


def _one_by_one(keys: pa.Array, texts: pa.Array, key: str, values: Callable, most: int):
    """Batches of what values(document, lists, most) puts into the lists."""
    decode, at, out = json.JSONDecoder().raw_decode, [], [[], [], [], [], []]
    for k, (_, v) in enumerate(_parsed(texts, decode)):
        for _ in values(v, out, most):
            at += [k] * (len(out[0]) - len(at))
            if len(at) >= most:
                yield _row_batch(key, keys.take(pa.array(at)), *out)
                for x in (at, *out):
                    x.clear()
    if at:
        yield _row_batch(key, keys.take(pa.array(at)), *out)


def _merged(a, b):
    """The form of both: types by key, a list's of its values, a scalar's type, None where nothing is known."""
    if a is None or b is None or a == b:
        return b if a is None else a
    if type(a) is dict and type(b) is dict:
        return a | {k: _merged(a.get(k), x) for k, x in b.items()}
    if type(a) is list and type(b) is list:
        return [_merged(a[0], b[0])]
    raise ValueError("values of several kinds")


def _form(v):
    kind = type(v)
    if kind is dict:
        return {k: _form(x) for k, x in v.items()}
    if kind is list:
        form = None
        for x in v:
            form = _merged(form, _form(x))
        return [form]
    return None if v is None else {int: pa.int64(), str: pa.string(), bool: pa.bool_()}[kind]


def _arrow_type(form) -> pa.DataType:
    if type(form) is dict:
        return pa.struct([(k, _arrow_type(x)) for k, x in form.items()])
    if type(form) is list:
        return pa.list_(_arrow_type(form[0]))
    return pa.null() if form is None else form


def _width(form) -> int:
    return 1 + sum(map(_width, form.values() if type(form) is dict else form if type(form) is list else ()))


def _as_columns(texts: pa.Array, form: dict) -> pa.Table | None:
    """Documents of that form, a row each; None if one of them has another."""
    lines = pc.binary_join_element_wise(texts.cast(pa.string()), "", "\n")
    ends = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
    raw = lines.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0]))
    if np.count_nonzero(np.frombuffer(raw, np.uint8) == 10) != len(texts):
        return None
    schema = pa.schema(list(_arrow_type(form)))
    how = pa.json.ParseOptions(explicit_schema=schema, unexpected_field_behavior="error")
    try:
        read = pa.json.read_json(pa.BufferReader(raw), pa.json.ReadOptions(use_threads=False, block_size=len(raw) + 1), how)
    except pa.ArrowException:
        return None
    return read.combine_chunks() if len(read) == len(texts) and read.schema.equals(schema) else None


def _named_columns(read: pa.Table, keys: pa.Array, key: str, name: str, ends: tuple[str, ...], most: int):
    """As _named, of documents read as columns: a column's values and the positions in arrays that led to them."""

    def fields(column):
        return zip((f.name for f in column.type), column.flatten())

    whole = [(n, c.chunk(0)) for n, c in zip(read.column_names, read.columns)]
    # A column of the walk: its documents, its path's parts between positions, the positions, its depth.
    waiting = [(n, c, np.arange(len(read)), ("$." + n,), (), 1) for n, c in whole]
    while waiting:
        step, column, rows, parts, at, depth = waiting.pop()
        kind = column.type
        if pa.types.is_struct(kind):
            waiting += [(n, c, rows, (*parts[:-1], f"{parts[-1]}.{n}"), at, depth + 1) for n, c in fields(column)]
        elif pa.types.is_list(kind):
            parent = pc.list_parent_indices(column).to_numpy()
            here = np.arange(len(parent)) - np.searchsorted(parent, parent)
            waiting.append((None, pc.list_flatten(column), rows[parent], (*parts[:-1], parts[-1] + "[", "]"), (*(x[parent] for x in at), here), depth + 1))
        elif step == name and not pa.types.is_null(kind):
            text = column.cast(pa.string())
            wanted = pc.ends_with(text, ends[0])
            for x in ends[1:]:
                wanted = pc.or_(wanted, pc.ends_with(text, x))
            wanted = np.flatnonzero(pc.fill_null(wanted, False).to_numpy(zero_copy_only=False))
            word = "string" if pa.types.is_string(kind) else "boolean" if pa.types.is_boolean(kind) else "number"
            for begin in range(0, len(wanted), most):
                some = wanted[begin : begin + most]
                n, path = len(some), [pa.array([parts[0]] * len(some))]
                for x, part in zip(at, parts[1:]):
                    path += [pa.array(x[some]).cast(pa.string()), part]
                path = pc.binary_join_element_wise(*path, "")
                yield _row_batch(key, keys.take(pa.array(rows[some])), path, [name] * n, [depth] * n, [word] * n, text.take(pa.array(some)))


def _pieces(batches, size: int):
    """Keys and texts of about so many characters."""
    for b in batches:
        total, at = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False)), 0
        while at < len(total):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, side="right")))
            yield b.column(0).slice(at, end - at), b.column(1).slice(at, end - at)
            at = end


def _find(plain: DataFrame, key: str, name: str, ends: tuple[str, ...]) -> DataFrame:
    """Texts under a name that have one of the ends. Documents that share the form of some first ones are read as columns,
    others, and those of many fields, one by one."""
    most, size = BATCH, READ

    def run(batches):
        decode, form, tries = json.JSONDecoder().raw_decode, None, 0
        for keys, texts in _pieces(batches, size):
            read = None
            if tries < FORMS and pc.sum(pc.binary_length(texts)).as_py() <= size:
                try:
                    if form is None:
                        for _, v in _parsed(texts.slice(0, LOOKED_AT), decode):
                            form = _merged(form, _form(v))
                    if type(form) is dict and 0 < len(form) and _width(form) <= FIELDS:
                        read = _as_columns(texts, form)
                except (KeyError, ValueError, RecursionError):
                    pass
                if read is None:
                    form, tries = None, tries + 1
            if read is None:
                yield from _one_by_one(keys, texts, key, lambda v, out, most: _named(v, name, ends, out, most), most)
            else:
                yield from _named_columns(read, keys, key, name, ends, most)

    return plain.mapInArrow(run, f"`{key}` {plain.schema[key].dataType.simpleString()}, {_WALKED}")


def walk(documents: DataFrame, key: str, doc: str) -> DataFrame:
    """As walk_levels, of any documents."""
    plain, others = _stored(documents, key, doc)
    most = BATCH

    def run(batches):
        for b in batches:
            yield from _one_by_one(b.column(0), b.column(1), key, _values, most)

    found = plain.mapInArrow(run, f"`{key}` {plain.schema[key].dataType.simpleString()}, {_WALKED}")
    return found if others.isEmpty() else found.unionByName(walk_levels(others, key, doc))


_POSITION = re.compile(r"\[[0-9]+\]")


class _Shape:
    """What stands at one shape of the documents at hand: how many values of each kind, and their texts."""

    __slots__ = ("shape", "depth", "steps", "numbers", "strings", "rest")

    def __init__(self, shape: str, depth: int):
        self.shape, self.depth, self.steps = shape, depth, {}
        self.numbers, self.strings, self.rest = [], [], {}

    def step(self, k: str | None) -> _Shape:
        """The shape under a key, or that of an array's values."""
        step = "[*]" if k is None else "." + _POSITION.sub("[*]", k)
        found = self.steps[k] = _Shape(self.shape + step, self.depth + 1)
        return found

    def add(self, v) -> None:
        waiting = [(self, v)]
        while waiting:
            at, v = waiting.pop()
            kind = type(v)
            if kind is dict:
                at.rest["object"] = at.rest.get("object", 0) + 1
                steps = at.steps
                for k, x in v.items():
                    inner = steps.get(k) or at.step(k)
                    if type(x) is int:
                        inner.numbers.append(x)
                    elif type(x) is str:
                        inner.strings.append(x)
                    else:
                        waiting.append((inner, x))
            elif kind is list:
                at.rest["array"] = at.rest.get("array", 0) + 1
                inner = at.steps.get(None) or at.step(None) if v else None
                for x in v:
                    if type(x) is int:
                        inner.numbers.append(x)
                    elif type(x) is str:
                        inner.strings.append(x)
                    else:
                        waiting.append((inner, x))
            elif kind is int:
                at.numbers.append(v)
            elif kind is str:
                at.strings.append(v)
            else:
                at.rest[v] = at.rest.get(v, 0) + 1

    def rows(self):
        """(shape, kind, depth, n, different texts) of this and of the inner shapes."""
        waiting = [self]
        while waiting:
            at = waiting.pop()
            waiting += at.steps.values()
            if at.numbers:
                yield at.shape, "number", at.depth, len(at.numbers), pa.array(at.numbers, pa.int64()).unique().cast(pa.string())
            if at.strings:
                yield at.shape, "string", at.depth, len(at.strings), pa.array(at.strings, pa.string()).unique()
            for v, n in at.rest.items():
                if v is None:
                    yield at.shape, "null", at.depth, n, pa.array([], pa.string())
                elif type(v) is bool:
                    yield at.shape, "boolean", at.depth, n, pa.array(["true" if v else "false"])
                else:
                    yield at.shape, v, at.depth, n, pa.array([], pa.string())


def _dealt(found) -> pa.RecordBatch:
    """Rows of _SHAPED: each shape's texts in buckets by their hash, its count with the first."""
    heads, sizes, parts = [], [], []
    for shape, kind, depth, n, texts in found:
        if len(texts):
            bucket = (pd.util.hash_array(texts.to_numpy(zero_copy_only=False).astype(object), categorize=False) % BUCKETS).astype(np.int64)
            parts.append(texts.take(pa.array(np.argsort(bucket, kind="stable"))))
            full = np.bincount(bucket, minlength=BUCKETS)
            for b in np.flatnonzero(full):
                heads.append((shape, kind, int(b), n, depth))
                sizes.append(full[b])
                n = 0
        else:
            heads.append((shape, kind, 0, n, depth))
            sizes.append(0)
    names, types = ["shape", "kind", "bucket", "n", "depth"], [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32()]
    columns = [pa.array(c, t) for c, t in zip(zip(*heads), types)]
    flat = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), flat)
    return pa.RecordBatch.from_arrays([*columns, lists], names=[*names, "texts"])


def shapes(documents: DataFrame, key: str, doc: str) -> DataFrame:
    """(shape, kind, n, n_values, depth): the paths of walk with array positions left out, how many values and how many
    different texts of them there are. A task leaves one of equal texts of its documents and deals them in packed buckets."""
    plain, others = _stored(documents, key, doc)

    def run(batches):
        decode = json.JSONDecoder().raw_decode
        top, size = _Shape("$", 0), 0
        for b in batches:
            for long, v in _parsed(b.column(1), decode):
                top.add(v)
                size += long
                if size >= GATHERED:
                    yield _dealt(top.rows())
                    top, size = _Shape("$", 0), 0
        if size:
            yield _dealt(top.rows())

    def packed(batches):
        for b in batches:
            seen = Counter(zip(*(c.to_pylist() for c in b.columns)))
            if seen:
                yield _dealt((shape, kind, depth, n, pa.array([] if value is None else [value], pa.string())) for (shape, kind, value, depth), n in seen.items())

    found = plain.mapInArrow(run, _SHAPED)
    if not others.isEmpty():
        shape = F.regexp_replace("path", r"\[[0-9]+\]", "[*]").alias("shape")
        found = found.unionByName(walk_levels(others, key, doc).select(shape, "kind", "value", "depth").mapInArrow(packed, _SHAPED))
    # Equal texts of a shape meet in its bucket, so one shuffle of packed rows serves both groupings.
    once = F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("n")).otherwise(0).alias("n")
    each = found.repartition("shape", "kind", "bucket").select("shape", "kind", "bucket", "n", "depth", F.posexplode_outer("texts").alias("pos", "value"))
    each = each.select("shape", "kind", "bucket", "value", "depth", once).groupBy("shape", "kind", "bucket", "value").agg(F.sum("n").alias("n"), F.max("depth").alias("depth"))
    return each.groupBy("shape", "kind").agg(F.sum("n").alias("n"), F.count("value").alias("n_values"), F.max("depth").alias("depth"))


def walk_levels(documents: DataFrame, key: str, doc: str) -> DataFrame:
    """(key, path, name, depth, kind, value) of every value in every document, at any depth, the document itself included.

    path is as in JSONPath, $.a.b[0].c; name is the last step's key (null in arrays and at the top); value is the text of
    a string, number or boolean, else null. A null document or one that is no JSON has no rows. Equal keys of documents
    are not told apart."""
    at = documents.select(key, F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), F.try_parse_json(doc).alias("v")).where("v IS NOT NULL")
    levels, depth = [], 0
    while True:
        at = temporary(at.withColumn("kind", _kind(F.col("v"))), "level")
        if at.isEmpty():
            break
        value = F.when(~F.col("kind").isin("object", "array", "null"), F.expr("CAST(v AS STRING)"))
        levels.append(at.select(key, "path", "name", F.lit(depth).alias("depth"), "kind", value.alias("value")))
        inner = at.where(F.col("kind").isin("object", "array")).lateralJoin(documents.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_v")))
        step = F.when(F.col("kind") == "array", F.concat(F.lit("["), F.col("_pos"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("_key")))
        at = inner.select(key, F.concat("path", step).alias("path"), F.when(F.col("kind") == "object", F.col("_key")).alias("name"), F.col("_v").alias("v"))
        depth += 1
    if not levels:
        return at.select(key, "path", "name", F.lit(0).alias("depth"), "kind", F.lit(None).cast("string").alias("value"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def found(documents: DataFrame, key: str, doc: str, name: str, pattern: str) -> DataFrame:
    """Values under a key of that name, at any depth, whose text has the pattern. Of plain documents, texts leave the walk
    only if they have an end that the pattern asks for; the pattern itself is Spark's to test."""
    plain, others = _stored(documents, key, doc)
    got = _find(plain, key, name, _ends(pattern))
    if not others.isEmpty():
        got = got.unionByName(walk_levels(others, key, doc).where(F.col("name") == name))
    return got.where(F.col("value").rlike(pattern))
