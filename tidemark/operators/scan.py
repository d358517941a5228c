"""Running values, numbers and frames over one series of any length, without a task that holds the series.

Rows are dealt by ranges of their order, sorted within each, and written with the number of their part; what is read
afterwards always means the same parts. A part scans its own rows. Totals of parts (one row a part and series) are scanned
on their own and carried into every part after them. Frames that reach over a part's edge get halos: copies of the nearest
rows of its neighbours, of as many neighbours as the frame needs.

What reaches the driver is a count for each part. Ties of the order keep together what a sort would; give an order that is
total where results depend on it. Nulls come first.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import temporary

PART, AT = "_part", "_at"
#: Rows up to which one series is a single window (a ledger with a row a day); counted first, longer ones are dealt.
SHORT = 5_000
#: Rows of a part, about, where Python holds a part.
PART_ROWS = 100_000
#: Facts of parts and series up to which they are broadcast, counted first.
MAX_BROADCAST = 100_000


def _short(rows: DataFrame, by: tuple[str, ...]) -> bool:
    return not by and rows.limit(SHORT + 1).count() <= SHORT


def null_safe(names: tuple[str, ...], left: str, right: str) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def attached(rows: DataFrame, facts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """rows with the other columns of facts, which has one row for each of the keys' values (nulls are values)."""
    side = F.broadcast(facts) if facts.count() <= MAX_BROADCAST else facts
    extra = [F.col(f"f.{c}") for c in facts.columns if c not in keys]
    return rows.alias("r").join(side.alias("f"), null_safe(keys, "r", "f")).select("r.*", *extra)


@dataclass(frozen=True)
class Laid:
    """Rows with their part and their position from 0 over all rows; begins has each part's number and first position."""

    rows: DataFrame
    begins: list[tuple[int, int]]
    n: int
    by: tuple[str, ...]

    def window(self) -> WindowSpec:
        """A series' rows in a part, in order."""
        return Window.partitionBy(PART, *self.by).orderBy(AT)


def lay_out(rows: DataFrame, order: list[str | Column], by: tuple[str, ...] = (), most: int | None = None) -> Laid:
    """rows dealt by ranges of (by, order) and sorted, as a table. most: about how many rows a part may have, where a task
    holds a part; else Spark's settings say how many parts there are."""
    spark, keys = rows.sparkSession, [*by, *order]
    n = 0 if most is None else rows.count()
    dealt = rows.repartitionByRange(*([n // most + 1] if most and n > most else []), *keys).sortWithinPartitions(*keys)
    table = temporary(dealt.withColumn(AT, F.monotonically_increasing_id()), "scan")
    part, within = F.shiftright(AT, 33).cast("int"), F.col(AT).bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r[PART], r["n"]) for r in table.groupBy(part.alias(PART)).agg(F.count("*").alias("n")).collect())
    begins, total = [], 0
    for p, n in counts:
        begins.append((p, total))
        total += n
    first = spark.createDataFrame(begins, T.StructType([T.StructField(PART, T.IntegerType()), T.StructField("_first", T.LongType())]))
    placed = table.withColumns({PART: part, AT: within}).join(F.broadcast(first), PART)  # one row a part
    placed = placed.select(*rows.columns, PART, (F.col("_first") + F.col(AT)).alias(AT))
    return Laid(placed, begins, total, tuple(by))


def numbered(rows: DataFrame, order: list[str | Column], by: tuple[str, ...] = (), name: str = "n", group: str | None = None) -> DataFrame:
    """rows with their number from 1 in their series and, if a name is given, the number from 1 of the series itself."""
    if _short(rows, by):
        return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    laid = lay_out(rows, order, by)
    if not by:
        return laid.rows.withColumn(name, F.col(AT) + 1).drop(PART, AT)
    facts = laid.rows.groupBy(PART, *by).agg(F.min(AT).alias("_begin"))
    series = Window.partitionBy(*by)
    facts = facts.withColumn("_begin", F.min("_begin").over(series))
    if group is not None:
        # Series by their first positions: as many rows as there are series, numbered like any others.
        each = facts.select(*by, "_begin").distinct()
        ranks = lay_out(each, ["_begin"])
        facts = facts.join(ranks.rows.select("_begin", (F.col(AT) + 1).alias(group)), "_begin")
    found = attached(laid.rows, temporary(facts, "series"), (PART, *by))
    return found.withColumn(name, F.col(AT) - F.col("_begin") + 1).drop(PART, AT, "_begin")


def _both(a: Column, b: Column, how: Callable[[Column, Column], Column]) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(how(a, b))


#: Kinds of running values: the aggregate in a frame, that of a part's rows, and what two neighbouring parts make.
KINDS: dict[str, tuple[Callable, Callable, Callable]] = {
    "sum": (F.sum, F.sum, lambda a, b: _both(a, b, lambda x, y: x + y)),
    "count": (F.count, F.count, lambda a, b: _both(a, b, lambda x, y: x + y)),
    "min": (F.min, F.min, F.least),
    "max": (F.max, F.max, F.greatest),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda c: F.max_by(c, F.when(c.isNotNull(), F.col(AT))), lambda a, b: F.coalesce(b, a)),
}


def running(rows: DataFrame, order: list[str | Column], values: dict[str, tuple[str, Column]], by: tuple[str, ...] = (), strictly: bool = False) -> DataFrame:
    """rows with running values from the series' begin up to each row (strictly: up to the one before).

    values: name -> (sum, count, min, max or last, value); last is the latest known value. Nulls don't count."""
    if _short(rows, by):
        frame = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strictly else 0)
        return rows.withColumns({name: KINDS[how][0](c).over(frame) for name, (how, c) in values.items()})
    held = {f"_v{k}": c for k, (_, c) in enumerate(values.values())}
    laid = lay_out(rows.withColumns(held), order, by)
    whole, parts = laid.window(), Window.partitionBy(*by).orderBy(PART)
    frame = whole.rowsBetween(Window.unboundedPreceding, -1 if strictly else 0)
    kinds = [(name, f"_v{k}", *KINDS[how]) for k, (name, (how, _)) in enumerate(values.items())]
    totals = laid.rows.groupBy(PART, *by).agg(*[of_part(F.col(v)).alias(v) for _, v, _, of_part, _ in kinds])
    # One row a part and series: what is carried into a part is scanned over them, and stored.
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    over = {"count": F.sum}
    hows = [how for how, _ in values.values()]
    carried = [over.get(how, KINDS[how][0])(F.col(v)).over(before).alias(f"_c{v}") for how, (_, v, *_) in zip(hows, kinds)]
    facts = temporary(totals.select(PART, *by, *carried), "carried")
    local = laid.rows.withColumns({name: in_frame(F.col(v)).over(frame) for name, v, in_frame, _, _ in kinds})
    found = attached(local, facts, (PART, *by))
    return found.withColumns({name: join(F.col(f"_c{v}"), F.col(name)) for name, v, _, _, join in kinds}).drop(PART, AT, *held, *[f"_c{v}" for v in held])


def _halos(laid: Laid, before: int, after: int, wrap: bool) -> list[tuple[int, int, int, int, int]]:
    """(from part, to part, first, end, moved): positions that a part lends to another, and how far they move there."""
    firsts = [f for _, f in laid.begins]
    out, n = [], laid.n
    for k, (part, first) in enumerate(laid.begins):
        end = firsts[k + 1] if k + 1 < len(firsts) else n
        for lo, hi in ((first - before, first), (end, end + after)):
            if not wrap:
                lo, hi = max(lo, 0), min(hi, n)
            while lo < hi:
                turn, at = divmod(lo, n)
                source = bisect.bisect_right(firsts, at) - 1
                stop = min(firsts[source + 1] if source + 1 < len(firsts) else n, at + hi - lo)
                out.append((laid.begins[source][0], part, at, stop, turn * n))
                lo += stop - at
    return out


def with_halos(laid: Laid, before: int, after: int, wrap: bool) -> DataFrame:
    """The rows of each part (_own) and copies of its neighbours' nearest rows, in the same positions."""
    own = laid.rows.withColumn("_own", F.lit(True))
    lent = _halos(laid, before, after, wrap)
    if not lent:
        return own
    table = F.broadcast(laid.rows.sparkSession.createDataFrame(lent, "_from int, _to int, _lo long, _hi long, _moved long"))  # some rows a part
    near = (F.col(PART) == F.col("_from")) & (F.col(AT) >= F.col("_lo")) & (F.col(AT) < F.col("_hi"))
    kept = [c for c in laid.rows.columns if c not in (PART, AT)]
    halo = laid.rows.join(table, near).select(*kept, F.col("_to").alias(PART), (F.col(AT) + F.col("_moved")).alias(AT), F.lit(False).alias("_own"))
    return own.unionByName(halo)


def _wrapped(rows: DataFrame, order: list[str | Column], before: int, after: int, columns: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """A short series between copies of itself, as many as the frames reach into."""
    n = max(rows.count(), 1)
    one = rows.withColumn(AT, F.row_number().over(Window.orderBy(*order)))
    turns = one.withColumn("_turn", F.explode(F.sequence(F.lit(-before // n), F.lit(-(-after // n)))))
    return turns.withColumns(columns(Window.orderBy("_turn", AT))).where("_turn = 0").drop("_turn", AT)


def framed(rows: DataFrame, order: list[str | Column], before: int, after: int, columns: Callable[[WindowSpec], dict[str, Column]], by: tuple[str, ...] = (), wrap: bool = False) -> DataFrame:
    """rows with columns over ROWS frames (lags and leads too) that reach at most so many rows before and after.

    columns gets a window of one series' rows in order and returns the columns. wrap: the last row is before the first."""
    if _short(rows, by):
        return _wrapped(rows, order, before, after, columns) if wrap else rows.withColumns(columns(Window.orderBy(*order)))
    laid = lay_out(rows, order, by)
    return with_halos(laid, before, after, wrap).withColumns(columns(laid.window())).where("_own").drop("_own", PART, AT)


def _time_halos(laid: Laid, at: str, by: tuple[str, ...], before: int) -> DataFrame | None:
    """(_from, _to, _lo, _series): parts that lend another the rows of its first series that are at _lo or later."""
    series = F.xxhash64(*by) if by else F.lit(0).cast("long")
    marks = laid.rows.groupBy(PART).agg(*[f(F.struct(AT, F.col(at).alias("t"), series.alias("s"))).alias(n) for n, f in (("first", F.min), ("last", F.max))])
    parts = sorted(marks.collect())  # one row a part
    lent = []
    for k, (to, first, _) in enumerate(parts):
        for source, _, last in reversed(parts[:k]):
            if last["s"] != first["s"] or last["t"] < first["t"] - before:
                break
            lent.append((source, to, first["t"] - before, first["s"]))
    return laid.rows.sparkSession.createDataFrame(lent, "_from int, _to int, _lo long, _series long") if lent else None


def framed_by_time(rows: DataFrame, on: str, span: int, columns: Callable[[WindowSpec, WindowSpec], dict[str, Column]], ties: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """rows with columns over RANGE frames that reach at most span back on a time or whole number (times in microseconds).

    columns gets two windows of a series: one ordered by the number, for frames of .rangeBetween(-span, ...), and one over
    rows in order (then by ties), for lags of a row. Rows that do not know the number get no part in any frame."""
    kind = rows.schema[on].dataType.simpleString()
    spot = F.unix_micros(F.col(on).cast("timestamp")) if kind.startswith("timestamp") else F.col(on).cast("long")
    placed = rows.withColumn("_t", spot)
    laid = lay_out(placed.where("_t IS NOT NULL"), ["_t", *ties], by)
    own = laid.rows.withColumn("_own", F.lit(True))
    lent = _time_halos(laid, "_t", by, span)
    if lent is not None:
        series = F.xxhash64(*by) if by else F.lit(0).cast("long")
        near = (F.col(PART) == F.col("_from")) & (F.col("_t") >= F.col("_lo")) & (series == F.col("_series"))
        halo = laid.rows.join(F.broadcast(lent), near).select(*placed.columns, F.col("_to").alias(PART), AT, F.lit(False).alias("_own"))  # some rows a part
        own = own.unionByName(halo)
    series = Window.partitionBy(PART, *by)
    made = columns(series.orderBy("_t"), series.orderBy(AT))
    out = own.withColumns(made).where("_own").drop("_own", PART, AT, "_t")
    return out.unionByName(rows.where(spot.isNull()), allowMissingColumns=True)


def covered_frames(rows: DataFrame, on: str, span: int, gap: int, values: dict[str, Column | tuple[str, Column]], ties: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """rows with n, widest and the values over the span before each row, strictly.

    widest is the longest stretch of the frame without a row, its edges included; where it is longer than gap (or the frame
    has no row), the values are null. A value is any aggregate, or (sum, min or max, column) as in totals.totals_within.
    Aggregates read each row's whole frame, in a task that holds it; pairs read no frame, so they stay linear where frames
    hold many rows."""
    stretch = "_next"
    if all(isinstance(v, tuple) for v in values.values()):
        return _covered_totals(rows, on, span, gap, values, ties, by)

    def columns(by_time: WindowSpec, in_order: WindowSpec) -> dict[str, Column]:
        frame = by_time.rangeBetween(-span, -1)
        inner = F.max(stretch).over(frame)
        edge = F.min("_t").over(frame) - (F.col("_t") - span)
        found = {"n": F.count("*").over(frame), "widest": F.coalesce(F.greatest(inner, edge), F.lit(span))}
        whole = (found["widest"] <= gap) & (found["n"] > 0)
        return found | {name: F.when(whole, v.over(frame)) for name, v in values.items()}

    spot = F.unix_micros(F.col(on).cast("timestamp")) if rows.schema[on].dataType.simpleString().startswith("timestamp") else F.col(on).cast("long")
    numbered_rows = rows.withColumn("_spot", spot)
    # How long it is to the next row of the series: a lead over one row.
    known = framed(numbered_rows, ["_spot", *ties], 0, 1, lambda w: {stretch: F.lead("_spot").over(w) - F.col("_spot")}, by)
    return framed_by_time(known, on, span, columns, ties, by).drop("_spot", stretch)


def _covered_totals(rows: DataFrame, on: str, span: int, gap: int, values: dict[str, tuple[str, Column]], ties: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    from .totals import totals_within

    spot = F.unix_micros(F.col(on).cast("timestamp")) if rows.schema[on].dataType.simpleString().startswith("timestamp") else F.col(on).cast("long")
    placed = rows.withColumn("_spot", spot)
    laid = lay_out(placed.where("_spot IS NOT NULL"), ["_spot", *ties], by)
    known = with_halos(laid, 0, 1, False).withColumn("_next", F.lead("_spot").over(laid.window()) - F.col("_spot")).where("_own")
    known = temporary(known.select(*placed.columns, "_next", F.col(AT).alias("_id")), "stretches")
    spans = known.select(*by, "_id", (F.col("_spot") - span).alias("_s"), F.col("_spot").alias("_e"))
    asked = {f"_x{k}": v for k, v in enumerate(values.values())}
    totals = totals_within(spans, known, F.col("_spot"), {"_inner": ("max", F.col("_next")), "_first": ("min", F.col("_spot")), **asked}, by)
    found = known.join(totals.withColumnRenamed("n", "_n"), "_id")
    widest = F.coalesce(F.greatest("_inner", F.col("_first") - (F.col("_spot") - span)), F.lit(span))
    whole = (widest <= gap) & (F.col("_n") > 0)
    out = found.select(*rows.columns, F.col("_n").alias("n"), widest.alias("widest"), *[F.when(whole, F.col(x)).alias(name) for name, x in zip(values, asked)])
    return out.unionByName(rows.where(spot.isNull()), allowMissingColumns=True)
