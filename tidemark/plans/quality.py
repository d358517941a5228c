"""Predicates, flags and audits over quote bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.moments import exact_quantiles
from ..operators import quality as Q
from ..sources.market import bars, daily, quotes, second_feed, table
from .registry import query
from .views import BARS, DAILY, FEED_B, FLAGGED, QUOTES, q6, r6, sql

_INVALID = " OR ".join(f"low_{s} <= 0 OR high_{s} < low_{s} OR high_{s} < open_{s} OR high_{s} < close_{s} OR low_{s} > open_{s} OR low_{s} > close_{s} OR NOT isfinite(open_{s}) OR NOT isfinite(close_{s})" for s in ("bid", "ask"))


@query("ohlc_invalid", sql(BARS, f"SELECT ({_INVALID}) AS invalid, count(*) AS n FROM bars GROUP BY 1"))
def ohlc_invalid(spark, sf):
    return bars(spark, sf).groupBy(Q.ohlc_invalid().alias("invalid")).agg(F.count("*").alias("n"))


@query("spread_invalid", sql(FLAGGED, "SELECT bar, spread_bad FROM flagged WHERE minute(bar) = 0"))
def spread_invalid(spark, sf):
    return bars(spark, sf).where(F.minute("bar") == 0).select("bar", Q.spread_invalid().alias("spread_bad"))


@query("spread_extreme", sql(FLAGGED, f"SELECT bar, {q6('spread_open', 'spread_open')}, {q6('spread_close', 'spread_close')} FROM flagged WHERE extreme"))
def spread_extreme(spark, sf):
    return bars(spark, sf).where(Q.spread_extreme()).select("bar", r6(Q.spread("open"), "spread_open"), r6(Q.spread("close"), "spread_close"))


_MIDS = BARS + ", m AS (SELECT bar, (open_bid + open_ask) / 2 AS mo, (close_bid + close_ask) / 2 AS mc FROM bars)"


@query("jump_flag", sql(FLAGGED, "SELECT bar, jump FROM flagged"))
def jump_flag(spark, sf):
    return Q.jump_flag(bars(spark, sf)).select("bar", "jump")


@query("jump_flag_monthly", sql(_MIDS, "SELECT bar, coalesce(abs(ln(mo / lag(mc) OVER (PARTITION BY date_trunc('month', bar) ORDER BY bar))) > 0.005, false) AS jump FROM m"))
def jump_flag_monthly(spark, sf):
    return Q.jump_flag(bars(spark, sf), 0.005, "monthly").select("bar", "jump")


@query("jump_flag_slot", sql(_MIDS, "SELECT m.bar, coalesce(abs(ln(m.mo / p.mc)) > 0.005, false) AS jump FROM m LEFT JOIN m p ON p.bar + INTERVAL '15 minutes' = m.bar"))
def jump_flag_slot(spark, sf):
    return Q.jump_flag(bars(spark, sf), 0.005, "slot").select("bar", "jump")


@query("flat_flag", sql(FLAGGED, "SELECT bar::DATE AS date, count(*) FILTER (flat)::BIGINT AS n_flat, count(*) AS n FROM flagged GROUP BY 1"))
def flat_flag(spark, sf):
    return bars(spark, sf).groupBy(F.to_date("bar").alias("date")).agg(F.count_if(Q.flat()).alias("n_flat"), F.count("*").alias("n"))


@query(
    "audit_summary",
    sql(FLAGGED, f"""SELECT count(*) FILTER ({_INVALID})::BIGINT AS n_invalid, count(*) FILTER (extreme OR jump OR spread_bad)::BIGINT AS n_flagged, count(*) FILTER (flat)::BIGINT AS n_flat,
    {q6("quantile_cont(spread_open, 0.5) FILTER (NOT (extreme OR jump OR spread_bad))", "p50")}, {q6("quantile_cont(spread_open, 0.95) FILTER (NOT (extreme OR jump OR spread_bad))", "p95")},
    {q6("quantile_cont(spread_open, 0.99) FILTER (NOT (extreme OR jump OR spread_bad))", "p99")}, {q6("max(spread_open) FILTER (NOT (extreme OR jump OR spread_bad))", "largest")} FROM flagged"""),
)
def audit_summary(spark, sf):
    f = Q.flagged(bars(spark, sf))
    clean = F.when(~F.col("suspect"), F.col("spread_open"))
    out = f.agg(F.count_if("invalid").alias("n_invalid"), F.count_if(F.col("suspect")).alias("n_flagged"), F.count_if("flat").alias("n_flat"), F.max(clean).alias("m"))
    found = zip(("p50", "p95", "p99"), exact_quantiles(f.select(clean.alias("clean")), "clean", [0.5, 0.95, 0.99]))
    return out.select("n_invalid", "n_flagged", "n_flat", *[r6(F.lit(v).cast("double"), k) for k, v in found], r6("m", "largest"))


@query(
    "monotonic_audit",
    """WITH t AS (SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM events)
    SELECT event_type, (count(*) - count(DISTINCT ts))::BIGINT AS duplicates, count(*) FILTER (ts < before)::BIGINT AS backward FROM t GROUP BY 1""",
)
def monotonic_audit(spark, sf):
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("event_type").orderBy("event_id"))
    t = table(spark, sf, "events").select("event_type", "ts", before.alias("before"))
    return t.groupBy("event_type").agg((F.count("*") - F.count_distinct("ts")).alias("duplicates"), F.count_if(F.col("ts") < F.col("before")).alias("backward"))


@query("dup_guard", "SELECT l_shipdate AS ts, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 25")
def dup_guard(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").alias("ts")).agg(F.count("*").alias("n")).where("n > 25")


@query("minute_align_guard", sql(QUOTES, "SELECT ts::DATE AS date, count(*) FILTER (epoch_us(ts) % 60000000 <> 0)::BIGINT AS misaligned, count(*) FILTER (date_trunc('minute', ts)::DATE <> ts::DATE)::BIGINT AS outside FROM quotes GROUP BY 1"))
def minute_align_guard(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return quotes(spark, sf).groupBy(F.to_date("ts").alias("date")).agg(F.count_if(us % 60_000_000 != 0).alias("misaligned"), F.count_if(F.to_date(F.date_trunc("minute", "ts")) != F.to_date("ts")).alias("outside"))


@query(
    "daily_missing_audit",
    sql(FLAGGED, """, g AS (SELECT bar::DATE AS date, bar, flat, date_diff('second', lag(bar) OVER (PARTITION BY bar::DATE, flat ORDER BY bar), bar) AS gap FROM flagged)
    SELECT date, count(*) AS n_bars, count(*) FILTER (NOT flat)::BIGINT AS active, count(*) FILTER (flat)::BIGINT AS inactive, max(gap) FILTER (NOT flat)::BIGINT AS max_active_gap, (isodow(date) - 1)::BIGINT AS weekday FROM g GROUP BY date""".replace(", g AS", " , g AS", 1)),
)
def daily_missing_audit(spark, sf):
    from pyspark.sql import Window

    b = bars(spark, sf).select(F.to_date("bar").alias("date"), "bar", Q.flat().alias("flat"))
    gap = F.unix_timestamp(F.col("bar").cast("timestamp")) - F.unix_timestamp(F.lag("bar").over(Window.partitionBy("date", "flat").orderBy("bar")).cast("timestamp"))
    g = b.withColumn("gap", gap)
    return g.groupBy("date").agg(F.count("*").alias("n_bars"), F.count_if(~F.col("flat")).alias("active"), F.count_if("flat").alias("inactive"), F.max(F.when(~F.col("flat"), F.col("gap"))).alias("max_active_gap")).withColumn("weekday", F.weekday("date").cast("long"))


SPLITS = {"development": ("1995-01-01", "1997-12-31"), "validation": ("1998-01-01", "1999-12-31"), "holdout": ("2000-01-01", "2001-12-31")}


@query("split_filter", sql(DAILY, f"SELECT date, {q6('d', 'd')} FROM daily WHERE date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'"))
def split_filter(spark, sf):
    lo, hi = SPLITS["validation"]
    return daily(spark, sf).where(F.col("date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))).select("date", r6("d", "d"))


@query("inf_nan_drop", sql(DAILY, f"SELECT date, {q6('l / nullif(a - a, 0) + a', 'ratio')}, {q6('ln(a)', 'log_a')} FROM daily WHERE a > 0 AND l IS NOT NULL AND a - a <> 0 UNION ALL SELECT date, NULL::DOUBLE, {q6('ln(a)', 'log_a')} FROM daily WHERE a > 0"))
def inf_nan_drop(spark, sf):
    d = daily(spark, sf).where("a > 0")
    odd = F.when(F.col("l").isNull(), F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return d.select("date", r6(Q.clean_number(odd), "ratio"), r6(Q.clean_number(F.log("a")), "log_a")).dropna(subset=["log_a"])


@query("masked_where", sql(DAILY, f"SELECT date, {q6('CASE WHEN d IS NOT NULL AND d < 20 THEN a END', 'a')} FROM daily"))
def masked_where(spark, sf):
    return daily(spark, sf).select("date", r6(F.when(Q.known(F.col("d") < 20), F.col("a")), "a"))


@query("add_prefix", sql(DAILY, f"SELECT date, {q6('a', 'asia_a')}, {q6('l', 'asia_l')} FROM daily"))
def add_prefix(spark, sf):
    return daily(spark, sf).select("date", r6("a", "a"), r6("l", "l")).withColumnsRenamed({"a": "asia_a", "l": "asia_l"})


@query("mid_price", sql(BARS + ", " + FEED_B, f"SELECT b.bar, {q6('(b.close_bid + b.close_ask) / 2', 'rebuilt')}, {q6('(f.close_bid + f.close_ask) / 2', 'native')}, {q6('(f.close_bid + f.close_ask) / 2 - (b.close_bid + b.close_ask) / 2', 'difference')} FROM bars b JOIN feed_b f USING (bar)"))
def mid_price(spark, sf):
    b = bars(spark, sf)
    x = b.select("bar", Q.mid("close").alias("rebuilt")).join(second_feed(b).select("bar", Q.mid("close").alias("native")), "bar")
    return x.select("bar", r6("rebuilt", "rebuilt"), r6("native", "native"), r6(F.col("native") - F.col("rebuilt"), "difference"))


@query("epoch_sentinel", "SELECT event_id, CASE WHEN user_id % 7 > 0 THEN make_timestamp((user_id % 7) * 86400000000) END AS since FROM events")
def epoch_sentinel(spark, sf):
    ms = (F.col("user_id") % 7) * 86_400_000
    return table(spark, sf, "events").select("event_id", F.when(ms > 0, F.timestamp_millis(ms)).cast("timestamp_ntz").alias("since"))


@query("orphan_filter", sql(BARS + ", " + FEED_B, "SELECT bar FROM bars WHERE bar NOT IN (SELECT bar FROM feed_b)"))
def orphan_filter(spark, sf):
    b = bars(spark, sf)
    return b.select("bar").join(second_feed(b).select("bar"), "bar", "left_anti")


@query(
    "first_failure_reason",
    sql(FLAGGED, "SELECT bar, CASE WHEN quote_count < 2 THEN 'insufficient_quotes' WHEN extreme THEN 'extreme_spread' WHEN jump THEN 'jump' WHEN flat THEN 'flat' ELSE 'ok' END AS reason FROM flagged"),
)
def first_failure_reason(spark, sf):
    f = Q.flagged(bars(spark, sf))
    return f.select("bar", Q.first_failure((F.col("quote_count") < 2, "insufficient_quotes"), (F.col("extreme"), "extreme_spread"), (F.col("jump"), "jump"), (F.col("flat"), "flat")).alias("reason"))
