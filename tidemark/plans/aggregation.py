"""Aggregations: sessions, coverage cubes, agreement tables, moments, quantile groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import moments as M
from ..operators import sessions as S
from ..sources.market import bars, daily, quotes, second_feed, table, trades
from .bars_and_sessions import _BLOCKS, _LONDON, flagged
from .registry import query
from .views import BARS, DAILY, FEED_B, FLAGGED, QUOTES, TRADES, q6, r6, sql

_PAIR = BARS + ", " + FEED_B


@query("rv_five_defs", sql(FLAGGED + _LONDON + _BLOCKS, f"""SELECT session_date, {q6('sum(ret * ret)', 'gap_safe')}, {q6('sum(bridged * bridged)', 'bridged')}, {q6('sum(ret * ret) FILTER (hour(block) < 11)', 'common_edge')}, {q6('sum(power(ln(c / o), 2))', 'open_close')},
{q6('sqrt(sum(ret * ret))', 'rooted')}, {q6('(sum(bridged * bridged) - sum(ret * ret)) / nullif(sum(ret * ret), 0)', 'relative')}, bool_or(hour(block) = 8) AS has_first, bool_or(hour(block) = 11) AS has_last FROM returns GROUP BY 1"""))
def rv_five_defs(spark, sf):
    w = S.blocks(S.in_session(flagged(spark, sf), S.LONDON), 60, "session_date").where("n_bars = 4")
    r = S.block_returns(w, 60, "session_date")
    r = S.block_returns(r.withColumnRenamed("ret", "safe"), 60, "session_date", bridge=True)
    sq = lambda c: F.sum(F.col(c) * F.col(c))
    return r.groupBy("session_date").agg(
        r6(sq("safe"), "gap_safe"), r6(sq("ret"), "bridged"), r6(F.sum(F.when(F.hour("block") < 11, F.col("safe") * F.col("safe"))), "common_edge"), r6(F.sum(F.pow(F.log(F.col("c") / F.col("o")), 2)), "open_close"),
        r6(F.sqrt(sq("safe")), "rooted"), r6(F.try_divide(sq("ret") - sq("safe"), sq("safe")), "relative"), F.bool_or(F.hour("block") == 8).alias("has_first"), F.bool_or(F.hour("block") == 11).alias("has_last"))


@query("same_edge_returns", sql(_PAIR, f""", m AS (SELECT bar, (b.close_bid + b.close_ask) / 2 AS x, (f.close_bid + f.close_ask) / 2 AS y FROM bars b JOIN feed_b f USING (bar)),
r AS (SELECT ln(x / lag(x) OVER w) AS rx, ln(y / lag(y) OVER w) AS ry, bar - lag(bar) OVER w AS step FROM m WINDOW w AS (PARTITION BY bar::DATE ORDER BY bar))
SELECT count(*) AS n, {q6('max(abs(rx - ry))', 'max_difference')}, {q6('corr(rx, ry)', 'correlation')} FROM r WHERE step = INTERVAL '15 minutes'"""))
def same_edge_returns(spark, sf):
    b = bars(spark, sf)
    mid = lambda d, n: d.select("bar", ((F.col("close_bid") + F.col("close_ask")) / 2).alias(n))
    day = Window.partitionBy(F.to_date("bar")).orderBy("bar")
    m = mid(b, "x").join(mid(second_feed(b), "y"), "bar")
    r = m.select(*[F.log(F.col(c) / F.lag(c).over(day)).alias(f"r{c}") for c in "xy"], (F.col("bar") - F.lag("bar").over(day)).alias("step")).where("step = INTERVAL '15' MINUTE")
    return r.agg(F.count("*").alias("n"), r6(F.max(F.abs(F.col("rx") - F.col("ry"))), "max_difference"), r6(F.corr("rx", "ry"), "correlation"))


@query("geometry_counts", sql(FLAGGED, "SELECT count(*) FILTER ((high_bid + high_ask) / 2 > high_ask)::BIGINT AS above, count(*) FILTER ((low_bid + low_ask) / 2 < low_bid)::BIGINT AS below, count(*) FILTER (mid_open < low_bid OR mid_open > high_ask)::BIGINT AS outside, count(*) AS n FROM flagged"))
def geometry_counts(spark, sf):
    f = flagged(spark, sf)
    return f.agg(F.count_if((F.col("high_bid") + F.col("high_ask")) / 2 > F.col("high_ask")).alias("above"), F.count_if((F.col("low_bid") + F.col("low_ask")) / 2 < F.col("low_bid")).alias("below"), F.count_if((F.col("mid_open") < F.col("low_bid")) | (F.col("mid_open") > F.col("high_ask"))).alias("outside"), F.count("*").alias("n"))


@query("agg_named", sql(DAILY, f"SELECT year(date)::INTEGER AS year, count(*) AS n, {q6('avg(a)', 'mean_a')}, {q6('max(l)', 'max_l')}, count(*) FILTER (a > 5)::BIGINT AS n_large FROM daily GROUP BY 1"))
def agg_named(spark, sf):
    return daily(spark, sf).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n"), r6(F.avg("a"), "mean_a"), r6(F.max("l"), "max_l"), F.count_if(F.col("a") > 5).alias("n_large"))


@query("agg_yearly_trades", sql(TRADES, f"SELECT book, year(exit_date)::INTEGER AS year, direction, count(*) AS n, {q6('sum(r)', 'total_r')}, {q6('100.0 * avg((r > 0)::INTEGER)', 'win_pct')} FROM trades GROUP BY 1, 2, 3"))
def agg_yearly_trades(spark, sf):
    return trades(spark, sf).groupBy("book", F.year("exit_date").alias("year"), "direction").agg(F.count("*").alias("n"), r6(F.sum("r"), "total_r"), r6(100.0 * F.avg((F.col("r") > 0).cast("int")), "win_pct"))


@query("agg_direction_weekday", sql(TRADES, f"SELECT book, direction, dayname(exit_date) AS day, {q6('sum(r)', 'total_r')} FROM trades GROUP BY 1, 2, 3"))
def agg_direction_weekday(spark, sf):
    return trades(spark, sf).groupBy("book", "direction", F.date_format("exit_date", "EEEE").alias("day")).agg(r6(F.sum("r"), "total_r"))


@query("session_spread_quantiles", sql(FLAGGED + _LONDON, f"SELECT {q6('quantile_cont(m, 0.5)', 'median')}, {q6('quantile_cont(m, 0.95)', 'p95')} FROM (SELECT quantile_cont(spread_close, 0.5) AS m FROM inside GROUP BY session_date)"))
def session_spread_quantiles(spark, sf):
    m = S.in_session(flagged(spark, sf), S.LONDON).groupBy("session_date").agg(F.percentile("spread_close", 0.5).alias("m"))
    return m.agg(r6(F.percentile("m", 0.5), "median"), r6(F.percentile("m", 0.95), "p95"))


@query("cash_pf", sql(TRADES, f"SELECT book, direction, {q6('sum(r * risk) FILTER (r > 0) / nullif(-sum(r * risk) FILTER (r < 0), 0)', 'profit_factor')} FROM trades GROUP BY 1, 2"))
def cash_pf(spark, sf):
    cash = F.col("r") * F.col("risk")
    return trades(spark, sf).groupBy("book", "direction").agg(r6(F.try_divide(F.sum(F.when(F.col("r") > 0, cash)), -F.sum(F.when(F.col("r") < 0, cash))), "profit_factor"))


@query("representative_row", sql(TRADES, f", m AS (SELECT *, abs(r - quantile_cont(r, 0.5) OVER (PARTITION BY book)) AS off FROM trades) SELECT book, 'median' AS kind, n, {q6('r', 'r')} FROM m QUALIFY row_number() OVER (PARTITION BY book ORDER BY round(off, 9), n) = 1 UNION ALL SELECT book, 'worst', n, {q6('r', 'r')} FROM trades QUALIFY row_number() OVER (PARTITION BY book ORDER BY r, n) = 1"))
def representative_row(spark, sf):
    t = trades(spark, sf)
    # A book's trades are some hundred rows: its median is an exact aggregate.
    t = t.join(t.groupBy("book").agg(F.percentile("r", 0.5).alias("middle")), "book")
    off = F.round(F.abs(F.col("r") - F.col("middle")), 9)
    pick = t.groupBy("book").agg(F.min_by(F.struct("n", "r"), F.struct(off, "n")).alias("median"), F.min_by(F.struct("n", "r"), F.struct("r", "n")).alias("worst"))
    return pick.select("book", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k)["n"].alias("n"), r6(F.col(k)["r"], "r")) for k in ("median", "worst")])).alias("x")).select("book", "x.*")


@query("valid_share", sql(DAILY, f"SELECT year(date)::INTEGER AS year, {q6('avg((d IS NOT NULL)::INTEGER)', 'share')} FROM daily GROUP BY 1"))
def valid_share(spark, sf):
    return daily(spark, sf).groupBy(F.year("date").alias("year")).agg(r6(F.avg(F.col("d").isNotNull().cast("int")), "share"))


@query("agg_annual_coverage", sql(DAILY, "SELECT year(date)::INTEGER AS year, count(*) AS dates, count(a) AS a_valid, count(l) AS l_valid, count(d) AS d_valid, count(*) FILTER (a IS NOT NULL AND l IS NOT NULL)::BIGINT AS eligible FROM daily GROUP BY 1"))
def agg_annual_coverage(spark, sf):
    return daily(spark, sf).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("dates"), F.count("a").alias("a_valid"), F.count("l").alias("l_valid"), F.count("d").alias("d_valid"), F.count_if(F.col("a").isNotNull() & F.col("l").isNotNull()).alias("eligible"))


@query("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("groupby_size", sql(DAILY, "SELECT year(date)::INTEGER AS year, (isodow(date) - 1)::INTEGER AS weekday, CASE WHEN a IS NULL THEN 'no_a' WHEN l IS NULL THEN 'no_l' WHEN r IS NULL THEN 'no_r' ELSE 'ok' END AS reason, count(*) AS n FROM daily GROUP BY 1, 2, 3"))
def groupby_size(spark, sf):
    reason = F.when(F.col("a").isNull(), "no_a").when(F.col("l").isNull(), "no_l").when(F.col("r").isNull(), "no_r").otherwise("ok")
    return daily(spark, sf).groupBy(F.year("date").alias("year"), F.weekday("date").alias("weekday"), reason.alias("reason")).agg(F.count("*").alias("n"))


@query("grouping_sets_cube", sql(BARS, f"""SELECT grouping_id(y, m, d, h)::BIGINT AS gid, y, m, d, h, count(*) AS received, {q6('count(*) / (count(DISTINCT bar::DATE) * 96.0)', 'share')}
FROM (SELECT bar, year(bar)::INTEGER AS y, month(bar)::INTEGER AS m, (isodow(bar) - 1)::INTEGER AS d, hour(bar)::INTEGER AS h FROM bars) GROUP BY GROUPING SETS ((y), (y, m), (d), (h), (y, h), (m, h), (d, h))"""))
def grouping_sets_cube(spark, sf):
    b = bars(spark, sf).select(F.to_date("bar").alias("day"), F.year("bar").alias("y"), F.month("bar").alias("m"), F.weekday("bar").alias("d"), F.hour("bar").alias("h"))
    cols = [F.col(c) for c in "ymdh"]
    sets = [[F.col(c) for c in s] for s in ("y", "ym", "d", "h", "yh", "mh", "dh")]
    # Counts a day and hour first: the sets then expand those few rows, not the bars.
    small = b.groupBy("day", *cols).agg(F.count("*").alias("n"))
    return small.groupingSets(sets, *cols).agg(F.grouping_id().cast("long").alias("gid"), F.sum("n").alias("received"), r6(F.sum("n") / (F.count_distinct("day") * 96.0), "share")).select("gid", *"ymdh", "received", "share")


@query("rollup_global_year", sql(DAILY, f"SELECT coalesce(y, 0)::INTEGER AS year, count(*) AS n, {q6('avg(a)', 'mean_a')}, {q6('quantile_cont(a, 0.5)', 'median_a')} FROM (SELECT year(date) AS y, a FROM daily) GROUP BY ROLLUP (y)"))
def rollup_global_year(spark, sf):
    return daily(spark, sf).select(F.year("date").alias("y"), "a").rollup("y").agg(F.count("*").alias("n"), r6(F.avg("a"), "mean_a"), r6(F.percentile("a", 0.5), "median_a")).select(F.coalesce("y", F.lit(0)).alias("year"), "n", "mean_a", "median_a")


@query("overlapping_groups", sql(BARS, "SELECT g AS scope, count(*) AS n, sum(quote_count)::BIGINT AS quotes FROM (SELECT quote_count, unnest(list_filter(['all', CASE WHEN hour(bar) < 6 THEN 'asia' END, CASE WHEN hour(bar) >= 8 AND hour(bar) < 12 THEN 'london' END, CASE WHEN quote_count < 3 THEN 'partial' END], lambda x: x IS NOT NULL)) AS g FROM bars) GROUP BY 1"))
def overlapping_groups(spark, sf):
    h = F.hour("bar")
    member = F.array_compact(F.array(F.lit("all"), F.when(h < 6, "asia"), F.when((h >= 8) & (h < 12), "london"), F.when(F.col("quote_count") < 3, "partial")))
    # Each membership pattern is counted once, then spread over its groups.
    patterns = bars(spark, sf).groupBy(member.alias("m")).agg(F.count("*").alias("n"), F.sum("quote_count").alias("quotes"))
    return patterns.select(F.explode("m").alias("scope"), "n", "quotes").groupBy("scope").agg(F.sum("n").alias("n"), F.sum("quotes").alias("quotes"))


@query("abs_diff_summary", sql(_PAIR, f""", x AS (SELECT f.close_bid - b.close_bid + (CASE WHEN b.quote_count > 4 THEN 0.0004::DOUBLE ELSE 0.0::DOUBLE END) AS d FROM bars b JOIN feed_b f USING (bar))
SELECT count(*) AS n, {q6('avg(d)', 'mean')}, {q6('quantile_cont(abs(d), 0.5)', 'p50')}, {q6('quantile_cont(abs(d), 0.95)', 'p95')}, {q6('quantile_cont(abs(d), 0.99)', 'p99')}, {q6('max(abs(d))', 'largest')}, {q6('avg((abs(d) <= 1e-9)::INTEGER)', 'exact')}, {q6('avg((abs(d) <= 0.0007)::INTEGER)', 'within')} FROM x"""))
def abs_diff_summary(spark, sf):
    b = bars(spark, sf)
    x = b.select("bar", "close_bid", "quote_count").join(second_feed(b).select("bar", F.col("close_bid").alias("other")), "bar")
    d = F.col("other") - F.col("close_bid") + F.when(F.col("quote_count") > 4, 0.0004).otherwise(0.0)
    x = x.select(d.alias("d"), F.abs(d).alias("ad"))
    out = x.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.max("ad").alias("largest"), F.avg((F.col("ad") <= 1e-9).cast("int")).alias("exact"), F.avg((F.col("ad") <= 0.0007).cast("int")).alias("within"))
    found = zip(("p50", "p95", "p99"), M.exact_quantiles(x, "ad", [0.5, 0.95, 0.99]))
    return out.select("n", r6("mean", "mean"), *[r6(F.lit(v).cast("double"), k) for k, v in found], r6("largest", "largest"), r6("exact", "exact"), r6("within", "within"))


@query("transition_matrix", sql(DAILY, "SELECT o.v AS old_valid, w.v AS new_valid, (SELECT count(*) FROM daily WHERE (d IS NOT NULL) = o.v AND (coalesce(d < 12, false)) = w.v) AS n FROM (VALUES (true), (false)) o(v), (VALUES (true), (false)) w(v)"))
def transition_matrix(spark, sf):
    cells = spark.createDataFrame([(a, b) for a in (True, False) for b in (True, False)], "old_valid boolean, new_valid boolean")
    seen = daily(spark, sf).groupBy(F.col("d").isNotNull().alias("old_valid"), F.coalesce(F.col("d") < 12, F.lit(False)).alias("new_valid")).agg(F.count("*").alias("n"))
    return cells.join(seen, ["old_valid", "new_valid"], "left").select("old_valid", "new_valid", F.coalesce("n", F.lit(0)).alias("n"))


@query("policy_compare", sql(FLAGGED, "SELECT policy, half, count(*) AS n, count(*) FILTER (keep)::BIGINT AS kept FROM (SELECT p AS policy, CASE WHEN day(bar) <= 15 THEN 'first' ELSE 'second' END AS half, CASE p WHEN 'all' THEN true WHEN 'no_flat' THEN NOT flat ELSE NOT (extreme OR jump OR spread_bad) AND NOT flat END AS keep FROM flagged, (VALUES ('all'), ('no_flat'), ('strict')) x(p)) GROUP BY 1, 2"))
def policy_compare(spark, sf):
    f = flagged(spark, sf)
    half = F.when(F.dayofmonth("bar") <= 15, "first").otherwise("second")
    # Every policy is a predicate over one pass; the three counts become rows afterwards.
    one = f.groupBy(half.alias("half")).agg(F.count("*").alias("n"), F.count_if(~F.col("flat")).alias("no_flat"), F.count_if(~F.col("suspect") & ~F.col("flat")).alias("strict"))
    return one.select("half", "n", F.explode(F.create_map(F.lit("all"), F.col("n"), F.lit("no_flat"), F.col("no_flat"), F.lit("strict"), F.col("strict"))).alias("policy", "kept")).select("policy", "half", "n", "kept")


@query("strata_by_count", sql(BARS, f"SELECT month(bar)::INTEGER AS month, quote_count, count(*) AS n, {q6('avg((open_bid = close_bid)::INTEGER)', 'equal_share')}, {q6('sum(close_ask - close_bid)', 'spread_sum')}, {q6('quantile_cont(close_ask - close_bid, 0.99)', 'spread_p99')} FROM bars GROUP BY 1, 2"))
def strata_by_count(spark, sf):
    s = F.col("close_ask") - F.col("close_bid")
    return bars(spark, sf).groupBy(F.month("bar").alias("month"), "quote_count").agg(F.count("*").alias("n"), r6(F.avg((F.col("open_bid") == F.col("close_bid")).cast("int")), "equal_share"), r6(F.sum(s), "spread_sum"), r6(F.percentile(s, 0.99), "spread_p99"))


@query("pivot", sql(BARS, "SELECT date, max(n) FILTER (s = 'asia') AS asia, max(n) FILTER (s = 'london') AS london, max(n) FILTER (s = 'rest') AS rest FROM (SELECT bar::DATE AS date, CASE WHEN hour(bar) < 6 THEN 'asia' WHEN hour(bar) >= 8 AND hour(bar) < 12 THEN 'london' ELSE 'rest' END AS s, count(*) AS n FROM bars GROUP BY 1, 2) GROUP BY 1"))
def pivot(spark, sf):
    h = F.hour("bar")
    s = F.when(h < 6, "asia").when((h >= 8) & (h < 12), "london").otherwise("rest")
    long = bars(spark, sf).groupBy(F.to_date("bar").alias("date"), s.alias("s")).agg(F.count("*").alias("n"))
    return long.groupBy("date").pivot("s", ["asia", "london", "rest"]).agg(F.first("n"))


@query("qcut_quintiles", sql(DAILY, f""", e AS (SELECT quantile_cont(a, 0.2) AS e1, quantile_cont(a, 0.4) AS e2, quantile_cont(a, 0.6) AS e3, quantile_cont(a, 0.8) AS e4 FROM daily WHERE a IS NOT NULL AND l IS NOT NULL)
SELECT CASE WHEN a <= e1 THEN 1 WHEN a <= e2 THEN 2 WHEN a <= e3 THEN 3 WHEN a <= e4 THEN 4 ELSE 5 END AS quintile, count(*) AS n, {q6('quantile_cont(a, 0.5)', 'median_a')}, {q6('avg(l)', 'mean_l')} FROM daily, e WHERE a IS NOT NULL AND l IS NOT NULL GROUP BY 1"""))
def qcut_quintiles(spark, sf):
    d = daily(spark, sf).dropna(subset=["a", "l"])
    return d.groupBy(M.bucket(F.col("a"), M.quantile_edges(d, "a", 5)).alias("quintile")).agg(F.count("*").alias("n"), r6(F.percentile("a", 0.5), "median_a"), r6(F.avg("l"), "mean_l"))


@query("state_quantile_groups", sql(DAILY, f""", k AS (SELECT a, l, row_number() OVER (ORDER BY a, date) AS rn, count(*) OVER () AS n FROM daily WHERE a IS NOT NULL AND l IS NOT NULL)
SELECT f::DOUBLE AS fraction, count(*) AS n, {q6('avg(l)', 'mean_l')} FROM k, (VALUES (0.1), (0.2), (0.3)) x(f) WHERE rn <= ceil(f::DOUBLE * n) GROUP BY 1"""))
def state_quantile_groups(spark, sf):
    d = daily(spark, sf).dropna(subset=["a", "l"])
    k = d.withColumns({"rn": F.row_number().over(Window.orderBy("a", "date")), "n": F.count("*").over(Window.partitionBy())})
    # A row belongs to every fraction that reaches it.
    member = F.array_compact(F.array(*[F.when(F.col("rn") <= F.ceil(F.lit(f) * F.col("n")), F.lit(f)) for f in (0.1, 0.2, 0.3)]))
    return k.select(F.explode(member).alias("fraction"), "l").groupBy("fraction").agg(F.count("*").alias("n"), r6(F.avg("l"), "mean_l"))


@query("moments", sql(DAILY, f"SELECT count(a) AS n, {q6('avg(a)', 'mean')}, {q6('quantile_cont(a, 0.5)', 'median')}, {q6('stddev_samp(a)', 'std')}, {q6('skewness(a)', 'skew')}, {q6('kurtosis(a)', 'kurtosis_excess')} FROM daily"))
def moments(spark, sf):
    a = F.col("a")
    return daily(spark, sf).agg(F.count("a").alias("n"), r6(F.avg("a"), "mean"), r6(F.percentile("a", 0.5), "median"), r6(F.stddev_samp("a"), "std"), r6(M.skew_corrected(a), "skew"), r6(M.kurtosis_corrected(a), "kurtosis_excess"))


@query("corr_pearson", sql(DAILY, f"SELECT year(date)::INTEGER AS year, {q6('corr(a, l)', 'r')} FROM daily GROUP BY 1"))
def corr_pearson(spark, sf):
    return daily(spark, sf).where("a IS NOT NULL AND l IS NOT NULL").groupBy(F.year("date").alias("year")).agg(r6(F.corr("a", "l"), "r"))


@query("corr_spearman", sql(DAILY, f""", k AS (SELECT rank() OVER (ORDER BY round(a)) + (count(*) OVER (PARTITION BY round(a)) - 1) / 2.0 AS ra, rank() OVER (ORDER BY round(l)) + (count(*) OVER (PARTITION BY round(l)) - 1) / 2.0 AS rl FROM daily WHERE a IS NOT NULL AND l IS NOT NULL) SELECT {q6('corr(ra, rl)', 'rho')} FROM k"""))
def corr_spearman(spark, sf):
    d = daily(spark, sf).dropna(subset=["a", "l"]).select(F.round("a").alias("a"), F.round("l").alias("l"))
    return M.average_rank(M.average_rank(d, "a", "ra"), "l", "rl").agg(r6(F.corr("ra", "rl"), "rho"))


@query("autocorr_lag1", sql(DAILY, f"SELECT {q6('corr(a, b)', 'rho')} FROM (SELECT a, lag(a) OVER (ORDER BY date) AS b FROM daily WHERE a IS NOT NULL)"))
def autocorr_lag1(spark, sf):
    d = daily(spark, sf).where("a IS NOT NULL").select("a", F.lag("a").over(Window.orderBy("date")).alias("b"))
    return d.where("b IS NOT NULL").agg(r6(F.corr("a", "b"), "rho"))


@query("histogram", sql(QUOTES, f", e AS (SELECT min(bid) AS lo, max(bid) AS hi FROM quotes) SELECT least(44, floor((bid - lo) / ((hi - lo) / 45)))::INTEGER AS bin, count(*) AS n, {q6('min(lo + least(44, floor((bid - lo) / ((hi - lo) / 45))) * ((hi - lo) / 45))', 'edge')} FROM quotes, e GROUP BY 1"))
def histogram(spark, sf):
    q = quotes(spark, sf)
    lo, hi = q.agg(F.min("bid"), F.max("bid")).head()
    width = F.lit(hi - lo) / 45
    b = F.least(F.lit(44), F.floor((F.col("bid") - lo) / width)).cast("int")
    return q.groupBy(b.alias("bin")).agg(F.count("*").alias("n")).withColumn("edge", r6(F.lit(lo) + F.col("bin") * width))


@query("missingness_diag", sql(DAILY, f"SELECT year(date)::INTEGER AS year, {q6('avg(a) FILTER (l IS NOT NULL)', 'a_if_observed')}, {q6('avg(a) FILTER (l IS NULL)', 'a_if_missing')}, count(*) FILTER (l IS NULL)::BIGINT AS n_missing FROM daily GROUP BY 1"))
def missingness_diag(spark, sf):
    seen = F.col("l").isNotNull()
    return daily(spark, sf).groupBy(F.year("date").alias("year")).agg(r6(F.avg(F.when(seen, F.col("a"))), "a_if_observed"), r6(F.avg(F.when(~seen, F.col("a"))), "a_if_missing"), F.count_if(~seen).alias("n_missing"))


@query("nunique", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT ts::DATE) AS days FROM events GROUP BY 1")
def nunique(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.to_date("ts")).alias("days"))


@query("distinct", "SELECT DISTINCT event_type, hour(ts)::INTEGER AS hour FROM events")
def distinct(spark, sf):
    return table(spark, sf, "events").select("event_type", F.hour("ts").alias("hour")).distinct()
