"""Totals of all points within each of many spans, without a row for each pair of them.

Points and both ends of every span are laid out together in order of time, so each part holds a bounded number of them,
however many points a span covers or however many spans cover a point. A part answers for its stretch of each span that
begins or ends in it: counts and sums by differences of running sums, least and greatest values by two overlapping runs of
a power of two. Parts that lie within a span as a whole are one row each; of those, runs are combined the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import temporary
from .scan import AT, PART, PART_ROWS, attached, lay_out

BEGIN, END, POINT = 0, 1, 2
_LONG = np.iinfo(np.int64)
#: What no value adds: by kind and type.
_NONE = {("sum", "bigint"): 0, ("min", "bigint"): _LONG.max, ("max", "bigint"): _LONG.min, ("min", "double"): float("nan"), ("max", "double"): float("-inf")}
#: NaN is greater than all other numbers, as in Spark's order: a least value passes over it, a greatest one is NaN.
_JOIN = {"min": np.fmin, "max": np.maximum}
_SPARK = {"sum": F.sum, "min": F.min, "max": F.max}


def _ranges(kind: str, values: np.ndarray, low: np.ndarray, high: np.ndarray, none: float) -> np.ndarray:
    """The sum, least or greatest of values[low:high] for each of many ranges."""
    if kind == "sum":
        upto = np.concatenate([[0], np.cumsum(values)])
        return upto[high] - upto[low]
    out = np.full(len(low), none, values.dtype)
    length, width, run = high - low, 1, values
    while (length >= width).any():  # run[i] is that of values[i : i + width]
        mine = (length >= width) & (length < 2 * width)
        out[mine] = _JOIN[kind](run[low[mine]], run[high[mine] - width])
        run = _JOIN[kind](run[:-width], run[width:]) if len(run) > width else run[:0]
        width *= 2
    return out


def totals_within(spans: DataFrame, points: DataFrame, at: Column, values: dict[str, tuple[str, Column]], by: tuple[str, ...] = (), most: int = PART_ROWS) -> DataFrame:
    """(_id, n, values): of the points at _s or later and before _e, and with the span's values of by (null is a value).

    spans: _id (different for each), _s, _e (long), by; spans that are empty or have an unknown end have no row. at: the
    points' place (long); unknown ones lie in no span. values: name -> (sum, min or max, value); sums are of whole numbers,
    the others of whole numbers or doubles. Nulls don't count; a value is null where none is known."""
    keys = [f"_by{k}" for k in range(len(by))]
    named = [F.col(c).alias(k) for c, k in zip(by, keys)]
    # A value's column, and whether it is known.
    held = [(how, points.select(c.alias("c")).schema["c"].dataType.simpleString(), c) for how, c in values.values()]
    held = [(how, "double" if how != "sum" and kind in ("double", "float") else "bigint" if kind in ("bigint", "int", "smallint", "tinyint") else kind, c) for how, kind, c in held]
    for how, kind, _ in held:
        if (how, kind) not in _NONE:
            raise ValueError(f"no {how} of {kind}")
    none = [_NONE[how, kind] for how, kind, _ in held]
    whole = spans.where("_s < _e")

    def ends(which: int, c: str) -> DataFrame:
        empty = [x for k, ((_, kind, _), z) in enumerate(zip(held, none)) for x in (F.lit(z).cast(kind).alias(f"_v{k}"), F.lit(0).cast("long").alias(f"_c{k}"))]
        return whole.select(*named, F.col(c).alias("_t"), F.lit(which).alias("_what"), "_id", *empty)

    given = [x for k, ((_, kind, c), z) in enumerate(zip(held, none)) for x in (F.coalesce(c.cast(kind), F.lit(z).cast(kind)).alias(f"_v{k}"), c.isNotNull().cast("long").alias(f"_c{k}"))]
    placed = points.select(*named, at.alias("_t"), F.lit(POINT).alias("_what"), F.monotonically_increasing_id().alias("_id"), *given).where("_t IS NOT NULL")
    both = ends(BEGIN, "_s").unionByName(ends(END, "_e")).unionByName(placed)
    # Points follow the ends at the same place: those belong to spans that begin there, not to those that end.
    laid = lay_out(both, ["_t", F.col("_what") == POINT, "_id"], tuple(keys), most)
    hows = [h for how, _, _ in held for h in (how, "sum")]
    columns = [c for k in range(len(held)) for c in (f"_v{k}", f"_c{k}")]
    zeros = [x for z in none for x in (z, 0)]
    types = ", ".join(f"_v{k} {kind}, _c{k} long" for k, (_, kind, _) in enumerate(held))
    schema = "_id long, _from int, _to int, n long" + (", " + types if types else "")

    # Arrow, as pandas would take NaN for a null.
    def part(f: pa.Table) -> pa.Table:
        f = f.sort_by(AT)
        number, what, ids = f[PART][0].as_py(), f["_what"].to_numpy(), f["_id"].to_numpy()
        point = what == POINT
        before = np.cumsum(point) - point
        m = int(point.sum())
        b, e = np.flatnonzero(what == BEGIN), np.flatnonzero(what == END)
        _, i, j = np.intersect1d(ids[b], ids[e], assume_unique=True, return_indices=True)
        first, last = np.delete(b, i), np.delete(e, j)  # spans that go on in later parts, or come from earlier ones
        low = np.concatenate([before[b[i]], before[first], np.zeros(len(last), int)])
        high = np.concatenate([before[e[j]], np.full(len(first), m), before[last]])
        edge = lambda x, y, z: np.repeat(np.array([x, y, z], np.int32), (len(i), len(first), len(last)))
        out = {"_id": np.concatenate([ids[b[i]], ids[first], ids[last]]), "_from": edge(-1, number, -1), "_to": edge(-1, -1, number), "n": high - low}
        for how, c, z in zip(hows, columns, zeros):
            out[c] = _ranges(how, f[c].to_numpy()[point], low, high, z)
        return pa.table(out)

    pieces = laid.rows.select(PART, AT, "_what", "_id", *columns).groupBy(PART).applyInArrow(part, schema)
    merged = [_SPARK[how](c).alias(c) for how, c in zip(hows, columns)]
    found = temporary(pieces.groupBy("_id").agg(F.max("_from").alias("_from"), F.max("_to").alias("_to"), F.sum("n").alias("n"), *merged), "pieces")
    between = found.select("_from", "_to").where("_from >= 0 AND _to > _from + 1").distinct()
    if not between.isEmpty():
        # One row a part; parts without points add nothing.
        rows = laid.rows.where(F.col("_what") == POINT).groupBy(PART).agg(F.count("*").alias("n"), *merged).toPandas()
        size = max(p for p, _ in laid.begins) + 1
        of_parts = {c: np.full(size, z, rows[c].dtype) for c, z in zip(["n", *columns], [0, *zeros])}
        for c, x in of_parts.items():
            x[rows[PART].to_numpy()] = rows[c].to_numpy()

        def fill(batches):
            for f in batches:
                low, high = f["_from"].to_numpy() + 1, f["_to"].to_numpy()
                within = {f"_m{c}": _ranges(how, x, low, high, z) for how, (c, x), z in zip(["sum", *hows], of_parts.items(), [0, *zeros])}
                yield pa.RecordBatch.from_pydict({"_from": f["_from"], "_to": f["_to"], **within})

        kinds = ", ".join(f"_m{c} {found.schema[c].dataType.simpleString()}" for c in of_parts)
        facts = temporary(between.mapInArrow(fill, f"_from int, _to int, {kinds}"), "parts-within")
        inner = attached(found.where("_from >= 0 AND _to > _from + 1"), facts, ("_from", "_to"))
        two = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}
        inner = inner.withColumns({c: two[how](F.col(c), F.col(f"_m{c}")) for how, c in zip(["sum", *hows], of_parts)}).select(*found.columns)
        found = found.where("NOT (_from >= 0 AND _to > _from + 1)").unionByName(inner)
    known = [F.when(F.col(f"_c{k}") > 0, F.col(f"_v{k}")).alias(name) for k, name in enumerate(values)]
    return found.select("_id", "n", *known)
