"""Time zones, sessions, calendars, bar aggregation and realised variance.

Bars find their session by an equi-join key derived from the local clock, never by a range join against windows.
Timestamps carry no zone and mean UTC; conversions name their zones, so the session time zone doesn't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Session:
    name: str
    zone: str
    start: int
    end: int

    @property
    def hours(self) -> int:
        return (self.end - self.start) % 24 or 24


SESSIONS = (Session("asia", "Asia/Tokyo", 9, 15), Session("london", "Europe/London", 8, 12), Session("evening", "America/New_York", 20, 23), Session("overnight", "America/New_York", 22, 3))
LONDON = SESSIONS[1]


def local(ts: Column | str, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts) if isinstance(ts, str) else ts)


def utc(ts: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)


def hours_later(ts: Column, hours: int) -> Column:
    return ts + F.make_dt_interval(hours=F.lit(hours))


def bounds(dates: DataFrame, session: Session, date: str = "date") -> DataFrame:
    """dates with starts and ends, UTC instants; an end not after the start is on the next day."""
    day = F.col(date).cast("timestamp_ntz")
    roll = 24 if session.end <= session.start else 0
    return dates.withColumns({"starts": utc(hours_later(day, session.start), session.zone), "ends": utc(hours_later(day, session.end + roll), session.zone)})


def in_session(bars: DataFrame, session: Session, ts: str = "bar", weekdays_only: bool = True) -> DataFrame:
    """The bars of a session with session_date, the local date on which it starts."""
    clock = local(ts, session.zone)
    hour = F.hour(clock)
    if session.end > session.start:
        inside, date = (hour >= session.start) & (hour < session.end), F.to_date(clock)
    else:
        inside, date = (hour >= session.start) | (hour < session.end), F.to_date(hours_later(clock, -session.end))
    out = bars.withColumn("session_date", date).where(inside)
    return out.where(F.weekday("session_date") < 5) if weekdays_only else out


def date_range(spark: SparkSession, first: str, last: str, weekdays: set[int] | None = None) -> DataFrame:
    """Days from first to last; weekdays: those to keep, Monday 0."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    return days if weekdays is None else days.where(F.weekday("date").isin(sorted(weekdays)))


def grid(days: DataFrame, minutes: int) -> DataFrame:
    """Every slot of each day: (date, bar)."""
    start = F.col("date").cast("timestamp_ntz")
    step = F.make_dt_interval(mins=F.lit(minutes))
    return days.select("date", F.explode(F.sequence(start, start + F.make_dt_interval(days=F.lit(1)) - step, step)).alias("bar"))


def blocks(bars: DataFrame, minutes: int, *keys: str, ts: str = "bar") -> DataFrame:
    """Larger bars of the mid price: first, last, highest, lowest and how many base bars each has."""
    at = F.window(ts, f"{minutes} minutes")["start"]
    return bars.groupBy(*keys, at.alias("block")).agg(F.min_by("mid_open", ts).alias("o"), F.max_by("mid_close", ts).alias("c"), F.max("high_bid").alias("h"), F.min("low_bid").alias("low"), F.sum("quote_count").alias("volume"), F.count("*").alias("n_bars"))


def block_returns(whole: DataFrame, minutes: int, *keys: str, bridge: bool = False) -> DataFrame:
    """Log returns of complete blocks within keys: the first is open to close; across a gap none, or with bridge from the
    last block there is."""
    order = Window.partitionBy(*keys).orderBy("block")
    before, when = F.lag("c").over(order), F.lag("block").over(order)
    joined = F.lit(True) if bridge else F.col("block") - when == F.make_dt_interval(mins=F.lit(minutes))
    ret = F.when(when.isNull(), F.log(F.col("c") / F.col("o"))).when(joined, F.log(F.col("c") / before))
    return whole.withColumn("ret", ret)


def realised_variance(bars: DataFrame, minutes: int, full: int, *keys: str, bridge: bool = False, root: bool = False) -> DataFrame:
    """(keys, n_blocks, n_returns, rv): the sum of squared returns of complete blocks (full base bars), or its root."""
    whole = blocks(bars, minutes, *keys).where(F.col("n_bars") == full)
    r = block_returns(whole, minutes, *keys, bridge=bridge)
    total = F.sum(F.col("ret") * F.col("ret"))
    return r.groupBy(*keys).agg(F.count("*").alias("n_blocks"), F.count("ret").alias("n_returns"), (F.sqrt(total) if root else total).alias("rv"))


def session_summary(bars: DataFrame, session: Session, base_minutes: int, min_share: float = 0.98, max_gap_minutes: int | None = 30) -> DataFrame:
    """One row a session: return, range, spread, minutes, gaps, edges, and whether it is valid, in one aggregate.

    Without a limit on gaps (None) any gap passes, as in the older rule that never applied its limit.
    """
    inside = in_session(bars, session)
    order = Window.partitionBy("session_date").orderBy("bar")
    gap = (F.unix_timestamp(F.col("bar").cast("timestamp")) - F.unix_timestamp(F.lag("bar").over(order).cast("timestamp"))) / 60
    rows = inside.withColumn("gap", gap).groupBy("session_date").agg(
        F.count("*").alias("n_bars"),
        F.min("bar").alias("first_bar"),
        F.max("bar").alias("last_bar"),
        F.max("gap").alias("max_gap"),
        F.bool_or("suspect").alias("any_suspect"),
        F.log(F.max_by("mid_close", "bar") / F.min_by("mid_open", "bar")).alias("ret"),
        (F.max("high_bid") - F.min("low_bid")).alias("range"),
        F.min_by("mid_open", "bar").alias("open"),
        F.percentile("spread_close", 0.5).alias("spread"),
    )
    expected = session.hours * 60 // base_minutes
    rows = bounds(rows, session, "session_date")
    edges = (F.col("first_bar") == F.col("starts")) & (F.col("last_bar") == F.col("ends") - F.make_dt_interval(mins=F.lit(base_minutes)))
    enough = F.col("n_bars") >= min_share * expected
    gaps = F.lit(True) if max_gap_minutes is None else F.coalesce("max_gap", F.lit(0.0)) <= max_gap_minutes
    return rows.withColumns({"range_pct": F.col("range") / F.col("open"), "edges": edges, "enough": enough, "gaps_ok": gaps}).withColumn("valid", edges & enough & gaps & ~F.col("any_suspect"))
