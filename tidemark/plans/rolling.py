"""Rolling, causal and running windows over the daily ledger and the trades."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rolling as R
from ..sources.market import bars, daily, trades
from .registry import query
from .views import BARS, DAILY, TRADES, q6, q6n, r6, r6n, sql

_V = DAILY + ", v AS (SELECT * FROM daily WHERE d IS NOT NULL)"
_P20 = "ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING"


#: Trades are kept apart by their book.
BOOK = ("book",)


def valid(spark, sf):
    return daily(spark, sf).where("d IS NOT NULL")


def _full(f: str, col: str, n: int = 20) -> str:
    frame = f"(ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({col}) OVER {frame} >= {n} THEN {f} OVER {frame} END"


@query("roll_median_shift", sql(_V, f"SELECT date, {q6(_full('quantile_cont(a, 0.5)', 'a'), 'med20')} FROM v"))
def roll_median_shift(spark, sf):
    return valid(spark, sf).select("date", r6(R.prior(F.col("a"), 20, "median", R.ordered("date")), "med20"))


@query("roll_std_shift", sql(_V, f"SELECT date, {q6(_full('stddev_samp(a)', 'a'), 'sd20')} FROM v"))
def roll_std_shift(spark, sf):
    return valid(spark, sf).select("date", r6(R.prior(F.col("a"), 20, "std", R.ordered("date")), "sd20"))


@query("lag_abs", sql(_V, f"SELECT date, {q6('abs(lag(a - l) OVER (ORDER BY date))', 'prev_abs')} FROM v"))
def lag_abs(spark, sf):
    return valid(spark, sf).select("date", r6(F.abs(F.lag(F.col("a") - F.col("l")).over(R.ordered("date"))), "prev_abs"))


@query("roll_mean_n", sql(_V, f"SELECT date, {q6('CASE WHEN count(*) OVER (ORDER BY date ROWS 4 PRECEDING) >= 5 THEN avg(d) OVER (ORDER BY date ROWS 4 PRECEDING) END', 'mean5')}, {q6('CASE WHEN count(*) OVER (ORDER BY date ROWS 19 PRECEDING) >= 20 THEN avg(d) OVER (ORDER BY date ROWS 19 PRECEDING) END', 'mean20')} FROM v"))
def roll_mean_n(spark, sf):
    def mean(n):
        frame = R.ordered("date").rowsBetween(1 - n, 0)
        return R.full(F.avg("d").over(frame), F.count("*").over(frame), n)

    return valid(spark, sf).select("date", r6(mean(5), "mean5"), r6(mean(20), "mean20"))


@query("rv_compression", sql(_V, f"SELECT date, {q6('ln(d / med)', 'log_compression')}, {q6('(a - l) * ln(d / med)', 'interaction')} FROM (SELECT *, {_full('quantile_cont(d, 0.5)', 'd')} AS med FROM v)"))
def rv_compression(spark, sf):
    med = R.prior(F.col("d"), 20, "median", R.ordered("date"))
    c = F.log(F.try_divide(F.col("d"), F.col("med")))
    return valid(spark, sf).withColumn("med", med).select("date", r6(c, "log_compression"), r6((F.col("a") - F.col("l")) * c, "interaction"))


@query("regime_highvol", sql(_V, f"SELECT date, CASE WHEN count(med) OVER (ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) >= 60 THEN (med > quantile_cont(med, 0.5) OVER (ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))::INTEGER END AS highvol FROM (SELECT date, {_full('quantile_cont(d, 0.5)', 'd')} AS med FROM v)"))
def regime_highvol(spark, sf):
    o = R.ordered("date")
    m = valid(spark, sf).select("date", R.prior(F.col("d"), 20, "median", o).alias("med"))
    return m.select("date", (F.col("med") > R.prior(F.col("med"), 60, "median", o)).cast("int").alias("highvol"))


@query("trend_strength", sql(_V, f"SELECT date, {q6('abs(s) / sqrt(q)', 'strength')}, (abs(s) / sqrt(q) >= 1)::INTEGER AS trend FROM (SELECT date, {_full('sum(a - l)', 'a')} AS s, {_full('sum((a - l) * (a - l))', 'a')} AS q FROM v)"))
def trend_strength(spark, sf):
    o, x = R.ordered("date"), F.col("a") - F.col("l")
    t = valid(spark, sf).select("date", R.prior(x, 20, "sum", o).alias("s"), R.prior(x * x, 20, "sum", o).alias("q"))
    strength = F.abs("s") / F.sqrt("q")
    return t.select("date", r6(strength, "strength"), (strength >= 1).cast("int").alias("trend"))


@query("percentile_rank_roll", sql(_V, f"SELECT date, {q6('CASE WHEN len(w) = 60 THEN len(list_filter(w, lambda x: x < d)) / 60.0 END', 'share_below')} FROM (SELECT date, d, list(d) OVER (ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS w FROM v)"))
def percentile_rank_roll(spark, sf):
    w = F.collect_list("d").over(R.ordered("date").rowsBetween(-60, -1))
    x = valid(spark, sf).select("date", "d", w.alias("w"))
    return x.select("date", r6(F.when(F.size("w") == 60, F.size(F.filter("w", lambda y: y < F.col("d"))) / 60.0), "share_below"))


@query("causal_lag_age", sql(DAILY, f"SELECT date, CASE WHEN date_diff('day', p, date) <= 4 THEN p END AS lag_date, {q6('CASE WHEN date_diff(' + chr(39) + 'day' + chr(39) + ', p, date) <= 4 THEN pv END', 'lag_value')} FROM (SELECT date, last_value(CASE WHEN d IS NOT NULL THEN date END IGNORE NULLS) OVER w AS p, last_value(d IGNORE NULLS) OVER w AS pv FROM daily WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"))
def causal_lag_age(spark, sf):
    return R.causal_lag(daily(spark, sf), "d").select("date", "lag_date", r6("lag_value", "lag_value"))


@query("box_rel_width", sql(DAILY, f"SELECT date, {q6('CASE WHEN count(d) OVER w >= 10 THEN d / quantile_cont(d, 0.5) OVER w END', 'rel_width')} FROM daily WINDOW w AS (ORDER BY date {_P20})"))
def box_rel_width(spark, sf):
    med = R.prior(F.col("d"), 20, "median", R.ordered("date"), at_least=10)
    return daily(spark, sf).select("date", r6(F.try_divide(F.col("d"), med), "rel_width"))


@query("cum_equity", sql(TRADES, f"SELECT book, n, {q6n('e', 'equity')}, {q6n('p', 'peak')}, {q6n('1 - e / p', 'drawdown')} FROM (SELECT book, n, e, greatest(1.0, max(e) OVER (PARTITION BY book ORDER BY n ROWS UNBOUNDED PRECEDING)) AS p FROM (SELECT book, n, exp(sum(ln(1 + 0.01 * r)) OVER (PARTITION BY book ORDER BY n ROWS UNBOUNDED PRECEDING)) AS e FROM trades))"))
def cum_equity(spark, sf):
    return R.equity(trades(spark, sf), F.lit(0.01), by=BOOK).select("book", "n", *[r6n(c, c) for c in ("equity", "peak", "drawdown")])


@query("equity_brake", sql(TRADES, f"SELECT book, n, {q6('CASE WHEN count(r) OVER w >= 20 AND round(sum(r) OVER w, 9) < -4 THEN 0.005 ELSE 0.01 END', 'fraction')} FROM trades WINDOW w AS (PARTITION BY book ORDER BY n {_P20})"))
def equity_brake(spark, sf):
    return trades(spark, sf).select("book", "n", r6(R.braked(by=BOOK), "fraction"))


@query("streak_loss", sql(TRADES, "SELECT book, max(c) AS longest, count(*) AS n_runs FROM (SELECT book, count(*) AS c FROM (SELECT book, r, row_number() OVER (PARTITION BY book ORDER BY n) - row_number() OVER (PARTITION BY book, r < 0 ORDER BY n) AS g FROM trades) WHERE r < 0 GROUP BY book, g) GROUP BY book"))
def streak_loss(spark, sf):
    return R.runs(trades(spark, sf), F.col("r") < 0, "n", BOOK).groupBy("book").agg(F.max("length").alias("longest"), F.count("*").alias("n_runs"))


@query("dd_duration", sql(TRADES, """, e AS (SELECT book, n, exp(sum(ln(1 + 0.01 * r)) OVER (PARTITION BY book ORDER BY n ROWS UNBOUNDED PRECEDING)) AS e FROM trades), p AS (SELECT book, n, 1 - e / greatest(1.0, max(e) OVER (PARTITION BY book ORDER BY n ROWS UNBOUNDED PRECEDING)) > 1e-9 AS below FROM e)
SELECT book, max(c) AS longest FROM (SELECT book, count(*) AS c FROM (SELECT book, below, row_number() OVER (PARTITION BY book ORDER BY n) - row_number() OVER (PARTITION BY book, below ORDER BY n) AS g FROM p) WHERE below GROUP BY book, g) GROUP BY book"""))
def dd_duration(spark, sf):
    e = R.equity(trades(spark, sf), F.lit(0.01), by=BOOK)
    return R.runs(e, F.col("drawdown") > R.DRAWN, "n", BOOK).groupBy("book").agg(F.max("length").alias("longest"))


@query("cum_qlike", sql(_V, f"SELECT date, {q6('sum(b - e) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)', 'gain')} FROM (SELECT date, l / m - ln(l / m) - 1 AS b, l / (0.5 * m + 0.5 * a) - ln(l / (0.5 * m + 0.5 * a)) - 1 AS e FROM (SELECT *, lag(l) OVER (ORDER BY date) AS m FROM v) WHERE m IS NOT NULL)"))
def cum_qlike(spark, sf):
    from ..functions.losses import qlike

    o = R.ordered("date")
    x = valid(spark, sf).withColumn("m", F.lag("l").over(o)).where("m IS NOT NULL")
    gain = qlike(F.col("l"), F.col("m")) - qlike(F.col("l"), 0.5 * F.col("m") + 0.5 * F.col("a"))
    return x.withColumn("g", gain).select("date", r6(F.sum("g").over(o.rowsBetween(Window.unboundedPreceding, 0)), "gain"))


@query("reserve_first_n", sql(DAILY, "SELECT date, CASE WHEN rn <= 400 THEN 'training' ELSE 'scored' END AS role FROM (SELECT date, row_number() OVER (ORDER BY date) AS rn FROM (SELECT date, count(d) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, d FROM daily) WHERE seen >= 20 AND d IS NOT NULL)"))
def reserve_first_n(spark, sf):
    o = R.ordered("date")
    seen = F.count("d").over(o.rowsBetween(Window.unboundedPreceding, -1))
    e = daily(spark, sf).withColumn("seen", seen).where("seen >= 20 AND d IS NOT NULL")
    return e.select("date", F.when(F.row_number().over(o) <= 400, "training").otherwise("scored").alias("role"))


@query("circular_block_sums", sql(_V, f", n AS (SELECT row_number() OVER (ORDER BY date) - 1 AS t, a, count(*) OVER () AS n FROM v), e AS (SELECT t, a, n FROM n UNION ALL SELECT t + n, a, n FROM n WHERE t < 9) SELECT t, {q6('s', 's')} FROM (SELECT t, n, sum(a) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS s FROM e) WHERE t < n"))
def circular_block_sums(spark, sf):
    return R.circular_block_sums(valid(spark, sf), "a", 10, "date").select(F.col("t").cast("long").alias("t"), r6("s", "s"))


@query("autocov_lags", sql(_V, f", z AS (SELECT row_number() OVER (ORDER BY date) AS t, a - avg(a) OVER () AS z, count(*) OVER () AS n FROM v) SELECT k::INTEGER AS lag, {q6('sum(x.z * y.z) / min(x.n)', 'gamma')} FROM range(0, 6) r(k) JOIN z x ON true JOIN z y ON y.t = x.t - k GROUP BY 1"))
def autocov_lags(spark, sf):
    from ..functions.stats import autocovariances

    return autocovariances(valid(spark, sf), "a", "date", 5).select("lag", r6("gamma", "gamma"))


@query("shift_diff", sql(_V, f"SELECT date, {q6('a - lag(a) OVER (ORDER BY date)', 'change')}, date_diff('day', lag(date) OVER (ORDER BY date), date)::INTEGER AS days FROM v"))
def shift_diff(spark, sf):
    o = R.ordered("date")
    return valid(spark, sf).select("date", r6(F.col("a") - F.lag("a").over(o), "change"), F.datediff("date", F.lag("date").over(o)).alias("days"))


@query("first_bar_of_day", sql(BARS, "SELECT bar, row_number() OVER (PARTITION BY bar::DATE ORDER BY bar) = 1 AS first FROM bars"))
def first_bar_of_day(spark, sf):
    day = Window.partitionBy(F.to_date("bar")).orderBy("bar")
    return bars(spark, sf).select("bar", (F.row_number().over(day) == 1).alias("first"))
