"""Evening boxes and breakout replay over quote bars, declaratively.

Bars reach their box by the local date on which the box opens; each step is an aggregate per box. What one bar can't
tell, an entry and a stop in the same bar, follows fixed rules: an entry bar that breaks both sides is ambiguous, and
the stop is checked from the entry bar on.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rolling import ordered, prior
from .sessions import hours_later, local


@dataclass(frozen=True)
class Rules:
    zone: str = "America/New_York"
    box_start: int = 20
    box_hours: int = 3
    entry_hours: int = 4
    exit_hours: int = 9  # after the box ends: 08:00
    base_minutes: int = 15
    least_blocks: int = 2
    least_width: float = 0.2
    threshold: float = 1.2
    cost: float = 1.0
    slip: float = 0.05
    commission: float = 0.07
    weekdays: tuple[int, ...] = (6, 0, 1, 2, 3)
    #: What a path between the box and its exit needs: this share of its bars, no gap over so many bars.
    path_share: float = 0.98
    path_gap_bars: int = 5


def _placed(bars: DataFrame, r: Rules) -> DataFrame:
    """bars with box_date and hours since the box opened, for those from its opening to the exit bar."""
    shifted = hours_later(local("bar", r.zone), -r.box_start)
    minutes = F.hour(shifted) * 60 + F.minute(shifted)
    last = (r.box_hours + r.exit_hours) * 60
    out = bars.withColumns({"box_date": F.to_date(shifted), "since": minutes})
    return out.where((F.col("since") <= last) & F.weekday("box_date").isin(list(r.weekdays)))


def boxes(bars: DataFrame, r: Rules = Rules()) -> DataFrame:
    """(box_date, hi, lo, width, n_blocks, valid, rel_width): rel_width against the median of the valid widths among the
    last 20 boxes, at least 10."""
    inside = _placed(bars, r).where(F.col("since") < r.box_hours * 60)
    blocks = inside.groupBy("box_date", F.floor(F.col("since") / 60).alias("hour")).agg(F.count("*").alias("n"), F.max("high_bid").alias("hi"), F.min("low_bid").alias("lo"), F.bool_or("suspect").alias("suspect"))
    whole = 60 // r.base_minutes
    b = blocks.groupBy("box_date").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.count_if(F.col("n") >= 0.75 * whole).alias("n_blocks"), F.bool_or("suspect").alias("suspect"))
    b = b.withColumn("width", F.col("hi") - F.col("lo"))
    b = b.withColumn("valid", (F.col("n_blocks") >= r.least_blocks) & (F.col("width") >= r.least_width) & ~F.col("suspect"))
    usual = prior(F.when(F.col("valid"), F.col("width")), 20, "median", ordered("box_date"), at_least=10)
    return b.withColumn("rel_width", F.try_divide(F.when(F.col("valid"), F.col("width")), usual))


def _complete(r: Rules, end: Column) -> Column:
    """An aggregate over a box's path bars (since, gap, suspect): all that a path needs, its first and last bar included."""
    start = r.box_hours * 60
    expected = (end - start) / r.base_minutes + 1
    enough = (F.count("*") >= r.path_share * F.max(expected)) & (F.count("*") >= 2)
    ends = F.bool_or(F.col("since") == start) & F.bool_or(F.col("since") == end)
    whole = F.coalesce(F.max("gap"), F.lit(0)) <= r.path_gap_bars * r.base_minutes
    return enough & ends & whole & ~F.bool_or(F.coalesce("suspect", F.lit(False)))


def paths(bars: DataFrame, boxed: DataFrame, r: Rules = Rules()) -> DataFrame:
    """The bars from each box's end to the exit bar, with since (minutes from the box's opening) and the box's columns."""
    return _placed(bars, r).where(F.col("since") >= r.box_hours * 60).join(boxed, "box_date")


def path_quality(bars: DataFrame, r: Rules = Rules()) -> DataFrame:
    """(box_date, n_path, largest_gap, suspect, complete) of the bars from the box's end to the exit bar."""
    path = _placed(bars, r).where(F.col("since") >= r.box_hours * 60)
    path = path.withColumn("gap", F.col("since") - F.lag("since").over(Window.partitionBy("box_date").orderBy("bar")))
    end = F.lit((r.box_hours + r.exit_hours) * 60)
    return path.groupBy("box_date").agg(F.count("*").alias("n_path"), F.max("gap").alias("largest_gap"), F.bool_or("suspect").alias("suspect"), _complete(r, end).alias("complete"))


def entries(bars: DataFrame, boxed: DataFrame, r: Rules = Rules()) -> DataFrame:
    """boxed with entry_bar, up, down, and the entry bar's quotes: the first bar of the entry window that breaks the box."""
    start = r.box_hours * 60
    window = _placed(bars, r).where((F.col("since") >= start) & (F.col("since") < start + r.entry_hours * 60))
    hit = window.join(boxed, "box_date").withColumns({"up": F.col("high_bid") >= F.col("hi"), "down": F.col("low_bid") <= F.col("lo")}).where("up OR down")
    quote = F.struct("bar", "up", "down", "open_bid", "open_ask")
    first = hit.groupBy("box_date").agg(F.min_by(quote, "bar").alias("e"))
    return boxed.join(first, "box_date", "left").select(*boxed.columns, F.col("e.bar").alias("entry_bar"), F.col("e.up").alias("up"), F.col("e.down").alias("down"), F.col("e.open_bid").alias("entry_open_bid"), F.col("e.open_ask").alias("entry_open_ask"))


def priced(entered: DataFrame, r: Rules = Rules()) -> DataFrame:
    """entered with long, entry, stop and risk. Fills are at the box edge or at a gap's open, at cost and slippage."""
    sp = F.col("entry_open_ask") - F.col("entry_open_bid")
    long = F.col("up")
    entry = F.when(long, F.greatest("hi", "entry_open_bid") + sp * r.cost + r.slip).otherwise(F.least("lo", "entry_open_bid") - r.slip)
    stop = F.when(long, F.col("lo")).otherwise(F.col("hi") + sp)
    out = entered.where("(up OR down) AND NOT (up AND down)").withColumns({"long": long, "entry": entry, "stop": stop})
    return out.withColumn("risk", F.abs(F.col("entry") - F.col("stop")))


def replay(bars: DataFrame, boxed: DataFrame, r: Rules = Rules(), gate: bool = True) -> DataFrame:
    """One row a box that is valid and narrow enough: status, entry, exit, R, excursions, holding minutes."""
    return swept(bars, boxed, r, {"base": {}}, gate).drop("variant")


#: Rules that variants of one sweep may change.
VARIED = ("threshold", "cost", "slip", "exit_hours")


def swept(bars: DataFrame, boxed: DataFrame, base: Rules, variants: dict[str, dict], gate: bool = True) -> DataFrame:
    """replay under each variant of the rules, tagged. Bars are read and shuffled once for all variants: windows over a
    variant's box find its entry, then its stop, and one aggregate on the same partitioning closes it.

    With gate, a box whose path is not complete is not priced: its status says so."""
    rules = {name: replace(base, **changes) for name, changes in variants.items()}
    if any(set(changes) - set(VARIED) for changes in variants.values()):
        raise ValueError(f"a sweep varies {VARIED} alone")
    some = [F.struct(F.lit(n).alias("variant"), F.lit(float(v.threshold)).alias("threshold"), F.lit(float(v.cost)).alias("cost"), F.lit(float(v.slip)).alias("slip"), F.lit((v.box_hours + v.exit_hours) * 60).alias("end")) for n, v in rules.items()]
    chosen = boxed.select("box_date", "hi", "lo", "valid", "rel_width", F.explode(F.array(*some)).alias("_v")).select("*", "_v.*").drop("_v")
    chosen = chosen.where(F.col("valid") & (F.col("rel_width") < F.col("threshold"))).drop("valid", "rel_width", "threshold")
    longest = replace(base, exit_hours=max(v.exit_hours for v in rules.values()))
    start = base.box_hours * 60
    path = _placed(bars, longest).where(F.col("since") >= start).join(chosen, "box_date").where(F.col("since") <= F.col("end"))

    box = Window.partitionBy("box_date", "variant")
    up, down = F.col("high_bid") >= F.col("hi"), F.col("low_bid") <= F.col("lo")
    hit = (F.col("since") < start + base.entry_hours * 60) & (up | down)
    first = F.min(F.when(hit, F.struct("bar", up.alias("up"), down.alias("down"), "open_bid", "open_ask"))).over(box)
    path = path.withColumns({"e": first, "gap": F.col("since") - F.lag("since").over(box.orderBy("bar"))})
    e, long = F.col("e"), F.col("e.up")
    one_sided = e["up"] != e["down"]
    at_entry = e["open_ask"] - e["open_bid"]
    entry = F.when(long, F.greatest(F.col("hi"), e["open_bid"]) + at_entry * F.col("cost") + F.col("slip")).otherwise(F.least(F.col("lo"), e["open_bid"]) - F.col("slip"))
    stop = F.when(long, F.col("lo")).otherwise(F.col("hi") + at_entry)
    path = path.withColumns({"entry": F.when(one_sided, entry), "stop": F.when(one_sided, stop)})
    path = path.withColumn("risk", F.abs(F.col("entry") - F.col("stop")))

    extra = (F.col("cost") - 1) * (F.col("open_ask") - F.col("open_bid")) / 2
    slip = F.col("slip")
    open_trade = (F.col("risk") > 0) & (F.col("bar") >= e["bar"])
    touched = open_trade & (F.col("since") < F.col("end")) & F.when(long, F.col("low_bid") - extra <= F.col("stop")).otherwise(F.col("high_ask") + extra >= F.col("stop"))
    stop_fill = F.when(long, F.least(F.col("stop"), F.col("open_bid") - extra) - slip).otherwise(F.greatest(F.col("stop"), F.col("open_ask") + extra) + slip)
    time_fill = F.when(long, F.col("open_bid") - extra - slip).otherwise(F.col("open_ask") + extra + slip)
    path = path.withColumn("s", F.min(F.when(touched, F.struct("bar", stop_fill.alias("fill")))).over(box))
    # Excursions include the stop's bar and exclude the bar of a time exit.
    seen = open_trade & F.when(F.col("s").isNotNull(), F.col("bar") <= F.col("s.bar")).otherwise(F.col("since") < F.col("end"))
    best = F.when(long, F.col("high_bid") - F.col("entry")).otherwise(F.col("entry") - F.col("low_ask")) / F.col("risk")
    worst = F.when(long, F.col("entry") - F.col("low_bid")).otherwise(F.col("high_ask") - F.col("entry")) / F.col("risk")
    at_end = F.when(open_trade & (F.col("since") == F.col("end")), F.struct("bar", time_fill.alias("fill")))
    done = path.groupBy("box_date", "variant").agg(
        _complete(base, F.col("end")).alias("complete"), F.max("e").alias("e"), F.max("entry").alias("entry"), F.max("stop").alias("stop"), F.max("risk").alias("risk"), F.max("s").alias("s"), F.max(at_end).alias("x"),
        F.greatest(F.lit(0.0), F.max(F.when(seen, best))).alias("mfe"), F.greatest(F.lit(0.0), F.max(F.when(seen, worst))).alias("mae"))
    out = chosen.select("box_date", "variant", "cost").join(done, ["box_date", "variant"], "left")

    refused = ~F.coalesce("complete", F.lit(False)) if gate else F.lit(False)
    priced_trade = (F.col("risk") > 0) & ~refused
    stopped = F.col("s").isNotNull()
    exit_bar, exit_ = F.coalesce(F.col("s.bar"), F.col("x.bar")), F.coalesce(F.col("s.fill"), F.col("x.fill"))
    pnl = F.when(F.col("e.up"), 1.0).otherwise(-1.0) * (exit_ - F.col("entry")) - base.commission * F.col("cost")
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    status = (
        F.when(refused, "incomplete_execution_path").when(F.col("e").isNull(), "no_breakout").when(F.col("e.up") & F.col("e.down"), "ambiguous_entry")
        .when(~(F.col("risk") > 0), "invalid_risk").when(exit_.isNull(), "missing_exit_quote").when(stopped, "stop").otherwise("time"))
    shown = {"long": F.col("e.up"), "entry": F.col("entry"), "stop": F.col("stop"), "risk": F.col("risk"), "exit": exit_, "stopped": stopped, "r": pnl / F.col("risk"), "minutes": (seconds(exit_bar) - seconds(F.col("e.bar"))) / 60, "mfe": F.col("mfe"), "mae": F.col("mae")}
    up_down = [F.when(~refused, F.col(f"e.{c}")).alias(c) for c in ("up", "down")]
    return out.select("box_date", "variant", *up_down, *[F.when(priced_trade, c).alias(k) for k, c in shown.items()], status.alias("status"))


def breach_distance(high: Column, low: Column, upper: Column, lower: Column, base: Column) -> Column:
    """How far a session went beyond the earlier one's range, in units of a base range; 0 if it stayed inside."""
    return F.try_divide(F.greatest(high - upper, lower - low, F.lit(0.0)), base)
