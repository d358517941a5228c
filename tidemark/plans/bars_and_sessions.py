"""Bars, sessions, calendars and realised variance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import sessions as S
from ..sources.market import bars, daily, quotes
from .registry import query
from .views import BARS, DAILY, FLAGGED, QUOTES, bars_sql, q6, r6, sql

_LONDON = """, clock AS (SELECT *, timezone('Europe/London', timezone('UTC', bar)) AS lt FROM flagged),
inside AS (SELECT *, lt::DATE AS session_date FROM clock WHERE hour(lt) >= 8 AND hour(lt) < 12 AND isodow(lt) < 6)"""
_BLOCKS = """, block AS (SELECT session_date, time_bucket(INTERVAL '60 minutes', bar) AS block, first(mid_open ORDER BY bar) AS o, last(mid_close ORDER BY bar) AS c, count(*) AS n_bars FROM inside GROUP BY 1, 2),
whole AS (SELECT * FROM block WHERE n_bars = 4),
returns AS (SELECT *, CASE WHEN lag(block) OVER w IS NULL THEN ln(c / o) WHEN block - lag(block) OVER w = INTERVAL '60 minutes' THEN ln(c / lag(c) OVER w) END AS ret,
  CASE WHEN lag(block) OVER w IS NULL THEN ln(c / o) ELSE ln(c / lag(c) OVER w) END AS bridged FROM whole WINDOW w AS (PARTITION BY session_date ORDER BY block))"""


def flagged(spark, sf):
    return Q.flagged(bars(spark, sf))


@query("entry_session_rv", sql(FLAGGED + _LONDON + _BLOCKS, f"""SELECT i.session_date, i.n_bars, i.any_suspect, coalesce(v.n_blocks, 0) AS n_blocks, {q6('v.rv', 'rv')}, CASE WHEN i.n_bars < 12 THEN 'insufficient_bars' WHEN i.any_suspect THEN 'flagged' WHEN v.n_blocks IS NULL THEN 'no_complete_block' ELSE 'ok' END AS reason
FROM (SELECT session_date, count(*) AS n_bars, bool_or(extreme OR jump OR spread_bad) AS any_suspect FROM inside GROUP BY 1) i
LEFT JOIN (SELECT session_date, count(*) AS n_blocks, sum(ret * ret) AS rv FROM returns GROUP BY 1) v USING (session_date)"""))
def entry_session_rv(spark, sf):
    inside = S.in_session(flagged(spark, sf), S.LONDON)
    seen = inside.groupBy("session_date").agg(F.count("*").alias("n_bars"), F.bool_or("suspect").alias("any_suspect"))
    rv = S.realised_variance(inside, 60, 4, "session_date")
    x = seen.join(rv, "session_date", "left")
    reason = Q.first_failure((F.col("n_bars") < 12, "insufficient_bars"), (F.col("any_suspect"), "flagged"), (F.col("n_blocks").isNull(), "no_complete_block"))
    return x.select("session_date", "n_bars", "any_suspect", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), r6("rv", "rv"), reason.alias("reason"))


@query("rv_gap_safe", sql(FLAGGED + _LONDON + _BLOCKS, f"SELECT session_date, count(*) AS n_blocks, count(ret) AS n_returns, {q6('sum(ret * ret)', 'rv')} FROM returns GROUP BY 1"))
def rv_gap_safe(spark, sf):
    return S.realised_variance(S.in_session(flagged(spark, sf), S.LONDON), 60, 4, "session_date").withColumn("rv", r6("rv"))


@query("rv_bridged_sqrt", sql(FLAGGED + _LONDON + _BLOCKS, f"SELECT session_date, count(*) AS n_blocks, count(bridged) AS n_returns, {q6('sqrt(sum(bridged * bridged))', 'rv')} FROM returns GROUP BY 1"))
def rv_bridged_sqrt(spark, sf):
    return S.realised_variance(S.in_session(flagged(spark, sf), S.LONDON), 60, 4, "session_date", bridge=True, root=True).withColumn("rv", r6("rv"))


@query("rv_components", sql(FLAGGED, f"""SELECT bar::DATE AS date, {q6('coalesce(sum(x) FILTER (hour(bar) < 6), 0)', 'a')}, {q6('coalesce(sum(x) FILTER (hour(bar) >= 8 AND hour(bar) < 12), 0)', 'l')}, {q6('coalesce(sum(x), 0)', 'd')}
FROM (SELECT bar, power(ln(mid_close / lag(mid_close) OVER (PARTITION BY bar::DATE ORDER BY bar)), 2) AS x FROM flagged) GROUP BY 1"""))
def rv_components(spark, sf):
    day = Window.partitionBy(F.to_date("bar")).orderBy("bar")
    x = flagged(spark, sf).select("bar", F.pow(F.log(F.col("mid_close") / F.lag("mid_close").over(day)), 2).alias("x"))
    h = F.hour("bar")
    zero = F.lit(0.0)
    return x.groupBy(F.to_date("bar").alias("date")).agg(r6(F.coalesce(F.sum(F.when(h < 6, F.col("x"))), zero), "a"), r6(F.coalesce(F.sum(F.when((h >= 8) & (h < 12), F.col("x"))), zero), "l"), r6(F.coalesce(F.sum("x"), zero), "d"))


@query("session_bounds", """WITH days AS (SELECT unnest(generate_series(DATE '2024-03-25', DATE '2024-04-05', INTERVAL '1 day'))::DATE AS date),
s(session, zone, a, b) AS (VALUES ('asia', 'Asia/Tokyo', 9, 15), ('london', 'Europe/London', 8, 12), ('evening', 'America/New_York', 20, 23), ('overnight', 'America/New_York', 22, 27))
SELECT session, date, timezone('UTC', timezone(zone, date::TIMESTAMP + to_hours(a))) AS starts, timezone('UTC', timezone(zone, date::TIMESTAMP + to_hours(b))) AS ends FROM days, s""")
def session_bounds(spark, sf):
    days = S.date_range(spark, "2024-03-25", "2024-04-05")
    parts = [S.bounds(days, s).select(F.lit(s.name).alias("session"), "date", "starts", "ends") for s in S.SESSIONS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("business_days", "SELECT d::DATE AS date FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL '1 day')) AS d) WHERE isodow(d) < 6")
def business_days(spark, sf):
    return S.date_range(spark, "2024-01-01", "2024-12-31", {0, 1, 2, 3, 4})


@query("calendar_days_dow_filter", "SELECT d::DATE AS date, dayname(d) AS day FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-03-31', INTERVAL '1 day')) AS d) WHERE isodow(d) - 1 IN (6, 0, 1, 2, 3)")
def calendar_days_dow_filter(spark, sf):
    return S.date_range(spark, "2024-01-01", "2024-03-31", {6, 0, 1, 2, 3}).withColumn("day", F.date_format("date", "EEEE"))


@query("range_slice", sql(BARS, f"SELECT bar, {q6('close_bid', 'close_bid')} FROM bars WHERE bar >= TIMESTAMP '2024-01-10 08:00:00' AND bar < TIMESTAMP '2024-01-10 12:00:00'"))
def range_slice(spark, sf):
    lo, hi = F.lit("2024-01-10 08:00:00").cast("timestamp_ntz"), F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    # The limits are slot edges, so they may cut the quotes before bars are made and reach the scan.
    from ..sources.market import ohlc

    return ohlc(quotes(spark, sf).where((F.col("ts") >= lo) & (F.col("ts") < hi))).select("bar", r6("close_bid", "close_bid"))


@query("session_assign", sql(BARS, """SELECT bar, CASE WHEN isodow(l) > 5 THEN 'weekend' WHEN hour(t) >= 9 AND hour(t) < 15 THEN 'asia' WHEN hour(l) >= 8 AND hour(l) < 12 THEN 'london' ELSE 'rest' END AS session
FROM (SELECT bar, timezone('Asia/Tokyo', timezone('UTC', bar)) AS t, timezone('Europe/London', timezone('UTC', bar)) AS l FROM bars)"""))
def session_assign(spark, sf):
    t, lon = F.hour(S.local("bar", "Asia/Tokyo")), S.local("bar", "Europe/London")
    name = F.when(F.weekday(lon) > 4, "weekend").when((t >= 9) & (t < 15), "asia").when((F.hour(lon) >= 8) & (F.hour(lon) < 12), "london").otherwise("rest")
    return bars(spark, sf).select("bar", name.alias("session"))


_HOURS = """, block AS (SELECT time_bucket(INTERVAL '60 minutes', bar) AS block, first(mid_open ORDER BY bar) AS o, last(mid_close ORDER BY bar) AS c, max(high_bid) AS h, min(low_bid) AS low, sum(quote_count)::BIGINT AS volume, count(*) AS n_bars FROM flagged GROUP BY 1)"""


@query("resample_m5", sql(FLAGGED + _HOURS, f"SELECT block, {q6('o', 'o')}, {q6('h', 'h')}, {q6('low', 'low')}, {q6('c', 'c')}, volume, n_bars FROM block"))
def resample_m5(spark, sf):
    b = S.blocks(flagged(spark, sf), 60)
    return b.select("block", r6("o", "o"), r6("h", "h"), r6("low", "low"), r6("c", "c"), "volume", "n_bars")


@query("complete_block", sql(FLAGGED + _HOURS, f"SELECT block, {q6('c', 'c')} FROM block WHERE n_bars = 4"))
def complete_block(spark, sf):
    return S.blocks(flagged(spark, sf), 60).where("n_bars = 4").select("block", r6("c", "c"))


@query("grid_densify", sql(BARS, """SELECT g.bar, coalesce(b.quote_count, 0) AS quote_count, b.bar IS NOT NULL AS present
FROM (SELECT unnest(generate_series(d, d + INTERVAL '1425 minutes', INTERVAL '15 minutes')) AS bar FROM (SELECT DISTINCT bar::DATE::TIMESTAMP AS d FROM bars)) g LEFT JOIN bars b USING (bar)"""))
def grid_densify(spark, sf):
    b = bars(spark, sf)
    slots = S.grid(b.select(F.to_date("bar").alias("date")).distinct(), 15)
    return slots.join(b.select("bar", "quote_count"), "bar", "left").select("bar", F.coalesce("quote_count", F.lit(0)).alias("quote_count"), F.col("quote_count").isNotNull().alias("present"))


@query("hour_minute_coverage", sql(BARS, """SELECT bar::DATE AS date, hour(bar)::INTEGER AS hour, count(*) AS received, (4 - count(*)) AS missing, count(*) = 4 AS complete,
count(*) FILTER (minute(bar) = 0) = 0 AS opening_absent, count(*) FILTER (minute(bar) = 45) = 0 AS closing_absent FROM bars GROUP BY 1, 2"""))
def hour_minute_coverage(spark, sf):
    g = bars(spark, sf).groupBy(F.to_date("bar").alias("date"), F.hour("bar").alias("hour"))
    return g.agg(F.count("*").alias("received"), (4 - F.count("*")).alias("missing"), (F.count("*") == 4).alias("complete"), (F.count_if(F.minute("bar") == 0) == 0).alias("opening_absent"), (F.count_if(F.minute("bar") == 45) == 0).alias("closing_absent"))


@query("max_gap", sql(BARS, "SELECT date, max(gap)::BIGINT AS max_gap_seconds FROM (SELECT bar::DATE AS date, date_diff('second', lag(bar) OVER (PARTITION BY bar::DATE ORDER BY bar), bar) AS gap FROM bars) GROUP BY 1"))
def max_gap(spark, sf):
    day = Window.partitionBy("date").orderBy("bar")
    b = bars(spark, sf).select(F.to_date("bar").alias("date"), "bar")
    sec = lambda c: F.unix_timestamp(c.cast("timestamp"))
    return b.withColumn("gap", sec(F.col("bar")) - sec(F.lag("bar").over(day))).groupBy("date").agg(F.max("gap").alias("max_gap_seconds"))


_SUMMARY = FLAGGED + _LONDON + """, gaps AS (SELECT *, date_diff('second', lag(bar) OVER (PARTITION BY session_date ORDER BY bar), bar) / 60.0 AS gap FROM inside),
summary AS (SELECT session_date, count(*) AS n_bars, min(bar) AS first_bar, max(bar) AS last_bar, max(gap) AS max_gap, bool_or(extreme OR jump OR spread_bad) AS any_suspect,
  ln(last(mid_close ORDER BY bar) / first(mid_open ORDER BY bar)) AS ret, max(high_bid) - min(low_bid) AS range, first(mid_open ORDER BY bar) AS open, quantile_cont(spread_close, 0.5) AS spread FROM gaps GROUP BY 1),
checked AS (SELECT *, first_bar = timezone('UTC', timezone('Europe/London', session_date::TIMESTAMP + INTERVAL '8 hours')) AND last_bar = timezone('UTC', timezone('Europe/London', session_date::TIMESTAMP + INTERVAL '12 hours')) - INTERVAL '15 minutes' AS edges FROM summary)"""


@query("session_valid", sql(_SUMMARY, "SELECT session_date, n_bars, edges, any_suspect, edges AND n_bars >= 0.98 * 16 AND coalesce(max_gap, 0) <= 30 AND NOT any_suspect AS valid FROM checked"))
def session_valid(spark, sf):
    return S.session_summary(flagged(spark, sf), S.LONDON, 15).select("session_date", "n_bars", "edges", "any_suspect", "valid")


@query("session_valid_legacy_gap", sql(_SUMMARY, "SELECT session_date, edges AND n_bars >= 0.75 * 16 AND NOT any_suspect AS legacy, edges AND n_bars >= 0.75 * 16 AND coalesce(max_gap, 0) <= 15 AND NOT any_suspect AS intended FROM checked"))
def session_valid_legacy_gap(spark, sf):
    f = flagged(spark, sf)
    old = S.session_summary(f, S.LONDON, 15, 0.75, None).select("session_date", F.col("valid").alias("legacy"))
    return old.join(S.session_summary(f, S.LONDON, 15, 0.75, 15).select("session_date", F.col("valid").alias("intended")), "session_date")


@query("agg_session", sql(_SUMMARY, f"SELECT session_date, {q6('ret', 'ret')}, {q6('range', 'range')}, {q6('range / open', 'range_pct')}, {q6('spread', 'spread')}, n_bars FROM checked"))
def agg_session(spark, sf):
    s = S.session_summary(flagged(spark, sf), S.LONDON, 15)
    return s.select("session_date", r6("ret", "ret"), r6("range", "range"), r6("range_pct", "range_pct"), r6("spread", "spread"), "n_bars")


@query("coverage_only_valid", sql(_SUMMARY, "SELECT session_date, n_bars >= 0.75 * 16 AND coalesce(max_gap, 0) <= 90 AS session_ok, n_bars >= 0.95 * 16 AND edges AND coalesce(max_gap, 0) <= 30 AS strict_ok FROM checked"))
def coverage_only_valid(spark, sf):
    loose = S.session_summary(flagged(spark, sf), S.LONDON, 15, 0.75, 90).select("session_date", (F.col("enough") & F.col("gaps_ok")).alias("session_ok"), "n_bars", "edges", "max_gap")
    strict = (F.col("n_bars") >= 0.95 * 16) & F.col("edges") & (F.coalesce("max_gap", F.lit(0.0)) <= 30)
    return loose.select("session_date", "session_ok", strict.alias("strict_ok"))


@query("tz_display", sql(QUOTES, "SELECT event_id, n::DATE AS ny_date, dayname(n) AS ny_day FROM (SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS n FROM quotes)"))
def tz_display(spark, sf):
    n = S.local("ts", "America/New_York")
    return quotes(spark, sf).select("event_id", F.to_date(n).alias("ny_date"), F.date_format(n, "EEEE").alias("ny_day"))


@query("month_resample", sql(DAILY, f"SELECT date_trunc('month', date)::DATE AS month, {q6('exp(sum(ln(1 + a / 100))) - 1', 'compounded')} FROM daily WHERE a IS NOT NULL GROUP BY 1"))
def month_resample(spark, sf):
    return daily(spark, sf).where("a IS NOT NULL").groupBy(F.trunc("date", "month").alias("month")).agg(r6(F.exp(F.sum(F.log1p(F.col("a") / 100))) - 1, "compounded"))


@query("year_resample", sql(DAILY, f"SELECT year(date)::INTEGER AS year, {q6('exp(sum(ln(1 + a / 100))) - 1', 'compounded')} FROM daily WHERE a IS NOT NULL GROUP BY 1"))
def year_resample(spark, sf):
    return daily(spark, sf).where("a IS NOT NULL").groupBy(F.year("date").alias("year")).agg(r6(F.exp(F.sum(F.log1p(F.col("a") / 100))) - 1, "compounded"))


@query("bar_offset_timing", sql(BARS, "SELECT time_bucket(INTERVAL '60 minutes', bar) AS block, min(minute(bar))::INTEGER AS opening_delay, (45 - max(minute(bar)))::INTEGER AS closing_shortfall FROM bars GROUP BY 1"))
def bar_offset_timing(spark, sf):
    return bars(spark, sf).groupBy(F.window("bar", "60 minutes")["start"].alias("block")).agg(F.min(F.minute("bar")).alias("opening_delay"), (45 - F.max(F.minute("bar"))).alias("closing_shortfall"))


@query("capacity_calendar", "SELECT y AS year, greatest(0, n - 400)::BIGINT AS after_400, greatest(0, n - 420)::BIGINT AS after_420 FROM (SELECT y, (SELECT count(*) FROM (SELECT unnest(generate_series(make_date(y, 1, 1), DATE '2024-12-31', INTERVAL '1 day')) AS d) WHERE isodow(d) < 6) AS n FROM range(2004, 2025) t(y))")
def capacity_calendar(spark, sf):
    years = spark.range(2004, 2025).withColumnRenamed("id", "year")
    n = years.select("year", F.explode(F.sequence(F.make_date(F.col("year").cast("int"), F.lit(1), F.lit(1)), F.lit("2024-12-31").cast("date"))).alias("d")).groupBy("year").agg(F.count_if(F.weekday("d") < 5).alias("n"))
    return n.select("year", F.greatest(F.lit(0), F.col("n") - 400).cast("long").alias("after_400"), F.greatest(F.lit(0), F.col("n") - 420).cast("long").alias("after_420"))


@query("bars_m1", sql(QUOTES + ", " + bars_sql(1, "m1"), f"SELECT bar::DATE AS date, count(*) AS n_bars, {q6('avg(close_ask - close_bid)', 'mean_spread')} FROM m1 GROUP BY 1"))
def bars_m1(spark, sf):
    return bars(spark, sf, 1).groupBy(F.to_date("bar").alias("date")).agg(F.count("*").alias("n_bars"), r6(F.avg(F.col("close_ask") - F.col("close_bid")), "mean_spread"))
