"""Data-quality predicates over quote bars. All flags are true or false, never null."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.market import FIELDS, SIDES


@dataclass(frozen=True)
class Limits:
    spread: float = 1.185
    jump: float = 0.01
    bar_minutes: int = 15


def known(c: Column) -> Column:
    """A comparison with a missing value is false."""
    return F.coalesce(c, F.lit(False))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def ohlc_invalid() -> Column:
    bad = []
    for s in SIDES:
        o, h, low, c = (F.col(f"{f}_{s}") for f in FIELDS)
        bad += [~_finite(x) for x in (o, h, low, c)] + [known(x) for x in (low <= 0, h < low, h < o, h < c, low > o, low > c)]
    return reduce(or_, bad)


def spread(which: str) -> Column:
    return F.col(f"{which}_ask") - F.col(f"{which}_bid")


def spread_invalid() -> Column:
    return known((spread("open") <= 0) | (spread("close") <= 0))


def spread_extreme(limit: float = Limits.spread) -> Column:
    return known(F.greatest(spread("open"), spread("close")) > limit)


def flat() -> Column:
    return known((F.col("high_bid") == F.col("low_bid")) & (F.col("high_ask") == F.col("low_ask")))


def mid(which: str) -> Column:
    return (F.col(f"{which}_bid") + F.col(f"{which}_ask")) / 2


def with_previous(bars: DataFrame, *columns: str, ts: str = "bar") -> DataFrame:
    """prev_<column> of the row before, over all time, without one global window.

    Rows are ordered within their day; a day's first row takes the last row of the latest earlier day, from a table of
    one row a day. The only unpartitioned window runs over days.
    """
    names = (ts, *columns)
    day = bars.withColumn("_day", F.to_date(ts))
    inside = Window.partitionBy("_day").orderBy(ts)
    row = F.struct(*names)
    lagged = day.withColumn("_prev", F.lag(row).over(inside))
    ends = day.groupBy("_day").agg(F.max_by(row, ts).alias("_last"))
    ends = ends.select("_day", F.lag("_last").over(Window.orderBy("_day")).alias("_before"))
    joined = lagged.join(ends, "_day", "left").withColumn("_prev", F.coalesce("_prev", "_before"))
    return joined.select(*bars.columns, *[F.col("_prev")[c].alias(f"prev_{c}") for c in names])


def jump_flag(bars: DataFrame, limit: float = Limits.jump, variant: str = "adjacent", minutes: int = Limits.bar_minutes) -> DataFrame:
    """bars with ``jump``: |ln(mid open / previous mid close)| over the limit.

    adjacent: the previous row of all, if exactly one bar before; monthly: the previous row of the same month, however
    long ago; slot: the previous grid slot, if it has quotes.
    """
    mids = bars.withColumns({"_mid_open": mid("open"), "_mid_close": mid("close")})
    if variant == "monthly":
        month = Window.partitionBy(F.trunc("bar", "month")).orderBy("bar")
        out = mids.withColumn("_before", F.lag("_mid_close").over(month))
        near = F.lit(True)
    elif variant == "slot":
        slot = mids.select((F.col("bar") + F.make_dt_interval(mins=F.lit(minutes))).alias("bar"), F.col("_mid_close").alias("_before"))
        out, near = mids.join(slot, "bar", "left"), F.lit(True)
    else:
        out = with_previous(mids, "_mid_close").withColumnRenamed("prev__mid_close", "_before")
        near = F.col("bar") - F.col("prev_bar") == F.make_dt_interval(mins=F.lit(minutes))
    moved = F.abs(F.log(F.col("_mid_open") / F.col("_before"))) > limit
    return out.select(*bars.columns, known(near & moved).alias("jump"))


def flagged(bars: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """bars with mid prices, spreads, and flags invalid, flat, spread_bad, extreme, jump, suspect."""
    out = jump_flag(bars, limits.jump, minutes=limits.bar_minutes)
    out = out.withColumns({"mid_open": mid("open"), "mid_close": mid("close"), "spread_open": spread("open"), "spread_close": spread("close"), "invalid": ohlc_invalid(), "flat": flat(), "spread_bad": spread_invalid(), "extreme": spread_extreme(limits.spread)})
    return out.withColumn("suspect", F.col("invalid") | F.col("spread_bad") | F.col("extreme") | F.col("jump"))


def first_failure(*rules: tuple[Column, str], otherwise: str = "ok") -> Column:
    """The reason of the first rule that holds; a rule that is null doesn't."""
    out = F
    for cond, reason in rules:
        out = out.when(known(cond), reason)
    return out.otherwise(otherwise)


def clean_number(c: Column) -> Column:
    """Infinite and not-a-number as null."""
    return F.when(_finite(c), c)
