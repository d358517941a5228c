"""Joins with the guarantees that time series need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import temporary
from .scan import MAX_BROADCAST, null_safe, running
from .totals import totals_within


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def one_to_one(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """An equi-join that refuses duplicate keys on either side instead of fanning out."""
    for name, side in (("left", left), ("right", right)):
        if found := duplicates(side, *keys).head(1):
            raise ValueError(f"the {name} side has duplicate keys, as {found[0].asDict()}")
    return left.join(right, list(keys), how)


def as_of(left: DataFrame, right: DataFrame, on: str, *values: str, by: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """left with as_of and the values of the latest right row before each left row (strictly, or up to it).

    One union and one running window for each by-group and month: linear after the sort, where a range join would be
    quadratic. A month's first rows take the last right row of the latest earlier month, from a table of one row a
    by-group and month. Only where ``on`` is no date or time is a by-group one window.
    """
    payload = F.struct(F.col(on).alias("as_of"), *values)
    order_right = 1 if strict else 0
    a = left.select(*[F.col(k) for k in by], F.col(on), F.lit(1 - order_right).alias("_turn"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_value"))
    b = right.select(*[F.col(k) for k in by], F.col(on), F.lit(order_right).alias("_turn"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), payload.alias("_value"))
    months = left.schema[on].dataType.simpleString() in ("date", "timestamp", "timestamp_ntz")
    month = F.trunc(F.col(on).cast("date"), "month") if months else F.lit(None).cast("date")
    both, keys = a.unionByName(b).withColumn("_month", month), (*by, "_month")
    upto = Window.partitionBy(*keys).orderBy(on, "_turn").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_found", F.last("_value", ignorenulls=True).over(upto)).where(F.col("_row").isNotNull() | F.lit(not months))
    if months:
        last = b.withColumn("_month", month).groupBy(*keys).agg(F.max_by("_value", on).alias("_last"))
        every = left.select(*by, month.alias("_month")).union(right.select(*by, month.alias("_month"))).distinct()
        earlier = Window.partitionBy(*by).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
        same = [F.col(k).eqNullSafe(F.col(f"_{k}_of")) for k in keys]
        ends = every.join(last.withColumnsRenamed({k: f"_{k}_of" for k in keys}), _all(same), "left")
        ends = ends.select(*keys, F.last("_last", ignorenulls=True).over(earlier).alias("_before")).withColumnsRenamed({k: f"_{k}_of" for k in keys})
        both = both.join(ends, _all(same), "left").withColumn("_found", F.coalesce("_found", "_before"))
    return both.where(F.col("_row").isNotNull()).select("_row.*", "_found.*")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with the side; empty if both hold the same set."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


#: Left copies in one bin beyond which the bin is split.
HOT = 10_000
MICROS = ("timestamp", "timestamp_ntz", "date")


def _spot(rows: DataFrame, c: str) -> Column:
    kind = rows.schema[c].dataType.simpleString()
    return F.unix_micros(F.col(c).cast("timestamp")) if kind in MICROS else F.col(c).cast("long")


def _spans(rows: DataFrame, span: tuple[str, str | None], by: tuple[str, ...], side: str) -> DataFrame:
    """(by, _<side> row, _<side>s, _<side>e, _<side>k): half-open spans that are not empty, with their level."""
    begin, end = _spot(rows, span[0]), None if span[1] is None else _spot(rows, span[1])
    out = rows.select(*[F.col(k).alias(f"_by{i}") for i, k in enumerate(by)], F.struct(*rows.columns).alias(side), begin.alias("_s"), (begin + 1 if end is None else end).alias("_e")).where("_s < _e")
    bits = F.length(F.bin(F.col("_e") - F.col("_s") - 1))
    return out.withColumn("_k", (F.ceil(bits / 2) * 2).cast("int"))


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str | None], right_span: tuple[str, str | None], by: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """(left, right): each pair of rows whose half-open spans [begin, end) meet, once, where the columns of by are equal.

    A span is two columns (times, or whole numbers), or one and None for a point. Spans that are empty or have an unknown
    end meet none.

    A span's level is the least width 4^k that holds it, so it touches two bins of that width at most. Two spans meet at
    the level of the longer one: each row has copies at its own level and at the levels above it that the other side has,
    which were measured. The join is an equality on (by, level, bin). A pair that shares two bins counts in the one where
    their common part begins. Bins with more than so many left copies are split: their left copies are dealt by number to
    several keys, the right ones go to each. A window of any length thus has a few copies, never one for each short bin.
    """
    a, b = _spans(left, left_span, by, "left"), _spans(right, right_span, by, "right")
    levels = [sorted(r[0] for r in x.select("_k").distinct().collect()) for x in (a, b)]  # at most 32 each
    keys = [f"_by{i}" for i in range(len(by))]

    def copies(x: DataFrame, others: list[int]) -> DataFrame:
        at = F.array_union(F.array("_k"), F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda k: k > F.col("_k")))
        x = x.withColumn("_level", F.explode(at))
        edge = lambda c: F.expr(f"shiftright({c}, _level)")
        return x.withColumn("_bin", F.explode(F.sequence(edge("_s"), edge("(_e - 1)"))))

    a, b, cell = copies(a, levels[1]), copies(b, levels[0]), [*keys, "_level", "_bin"]
    busy = a.groupBy(*cell).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).withColumn("_parts", F.ceil(F.col("_n") / hot).cast("int")).drop("_n")
    busy = temporary(busy, "busy-bins")
    if not busy.isEmpty():
        a, b = (attached_left(x, busy, cell).withColumn("_parts", F.coalesce("_parts", F.lit(1))) for x in (a, b))
        a = a.withColumn("_deal", F.pmod(F.monotonically_increasing_id(), F.col("_parts")).cast("int"))
        b = b.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        cell = [*cell, "_deal"]
    x, y = a.alias("a"), b.alias("b")
    same = _all([F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) if k in keys else F.col(f"a.{k}") == F.col(f"b.{k}") for k in cell])
    meet = (F.col("a._s") < F.col("b._e")) & (F.col("b._s") < F.col("a._e")) & (F.greatest("a._k", "b._k") == F.col("a._level"))
    once = F.expr("shiftright(greatest(a._s, b._s), a._level)") == F.col("a._bin")
    return x.join(y, same & meet & once).select("left", "right")


def interval_totals(spans: DataFrame, points: DataFrame, span: tuple[str, str], at: str, values: dict[str, tuple[str, Column]], by: tuple[str, ...] = ()) -> DataFrame:
    """spans with n (their points, at least one) and values (sum, min or max) of those points: interval_join with a point,
    and its totals by span, without its pairs, which may be as many as spans times points."""
    numbered = temporary(spans.withColumn("_id", F.monotonically_increasing_id()), "spans")
    ends = numbered.select(*by, "_id", _spot(numbered, span[0]).alias("_s"), _spot(numbered, span[1]).alias("_e"))
    found = totals_within(ends, points, _spot(points, at), values, by).where("n > 0")
    return numbered.join(found, "_id").drop("_id")


def overlap_totals(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """left with n (long) and common (decimal): how many right spans each left span meets (at least one), and the sum of
    their common parts. As interval_join and its totals, without its pairs.

    Of the right spans, those that begin before a left one ends meet it, but for those that have ended when it begins. Up to
    a time t they cover, in all, t - begin of each that has begun less t - end of each that has ended. So running counts and
    sums at a left span's two ends are enough: four rows a pair of spans, in order, and one scan."""
    numbered = temporary(left.withColumn("_id", F.monotonically_increasing_id()), "spans")
    keys, none = [f"_by{k}" for k in range(len(by))], F.lit(None).cast("long")

    def ends(rows: DataFrame, span: tuple[str, str], ident: Column, turns: tuple[int, int], adds: bool) -> DataFrame:
        x = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], ident.alias("_id"), _spot(rows, span[0]).alias("_s"), _spot(rows, span[1]).alias("_e")).where("_s < _e")
        each = [F.struct(F.col(c).alias("_t"), F.lit(turn).alias("_turn"), F.lit(sign).alias("_sign")) for c, turn, sign in zip(("_s", "_e"), turns, (1, -1))]
        x = x.select(*keys, "_id", F.explode(F.array(*each)).alias("x")).select(*keys, "_id", "x.*")
        return x.withColumn("_adds", F.lit(adds))

    # At one time: right spans end, then left ones begin or end, then right ones begin.
    marks = ends(numbered, left_span, F.col("_id"), (1, 1), False).unionByName(ends(right, right_span, none, (2, 0), True))
    begun, ended = F.col("_adds") & (F.col("_sign") > 0), F.col("_adds") & (F.col("_sign") < 0)
    one, t = F.lit(1).cast("long"), F.col("_t").cast("decimal(38,0)")
    values = {"_begun": F.when(begun, one), "_ended": F.when(ended, one), "_moved": F.when(F.col("_adds"), t * F.col("_sign"))}
    upto = running(marks, ["_t", "_turn", "_id"], {name: ("sum", v.cast("decimal(38,0)")) for name, v in values.items()}, tuple(keys)).where("NOT _adds")
    upto = upto.withColumns({c: F.coalesce(c, F.lit(0).cast("decimal(38,0)")) for c in values})
    first = F.col("_sign") > 0
    covered = (t * (F.col("_begun") - F.col("_ended"))).cast("decimal(38,0)") - F.col("_moved")
    n = F.sum(F.when(first, -F.col("_ended")).otherwise(F.col("_begun"))).cast("long")
    found = upto.groupBy("_id").agg(n.alias("n"), F.sum(-F.col("_sign") * covered).alias("common")).where("n > 0")
    return numbered.join(found, "_id").drop("_id")


def attached_left(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the other columns of facts where it has the keys' values; broadcast if it is counted small."""
    side = F.broadcast(facts) if facts.count() <= MAX_BROADCAST else facts
    extra = [F.col(f"f.{c}") for c in facts.columns if c not in keys]
    return rows.alias("r").join(side.alias("f"), null_safe(tuple(keys), "r", "f"), "left").select("r.*", *extra)
