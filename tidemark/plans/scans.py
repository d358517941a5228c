"""Series with a row an event: running values, frames, lags and regressions over all of a table, in no single task."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import losses as L
from ..functions import stats as ST
from ..operators import rolling as R
from ..operators import order_stats as OS
from ..operators import scan as SC
from ..operators import shifts as SH
from ..sources.market import table
from .registry import query
from .statistics import _omega
from .views import q6, r6

ORDER = ["ts", "event_id"]
LAGS = 20
_E = "WITH e AS (SELECT ts, event_id, event_type, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS t, count(*) OVER () AS n FROM events)"


def events(spark, sf):
    return table(spark, sf, "events").select("ts", "event_id", "event_type", "value")


@query("events_running", f"""{_E}, c AS (SELECT *, sum(round(value * 100)::BIGINT - 5000) OVER w AS level FROM e WINDOW w AS (ORDER BY t))
SELECT event_id, t + 1 AS n, level::BIGINT AS level, (greatest(0, max(level) OVER (ORDER BY t)) - level)::BIGINT AS below_peak, count(*) FILTER (event_type = 'error') OVER (ORDER BY t) AS errors,
       last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM c""")
def events_running(spark, sf):
    """Numbers, a running level and its distance from its peak, counts, and the latest purchase strictly before each event."""
    e = SC.numbered(events(spark, sf), ORDER)
    cents = F.round(F.col("value") * 100).cast("long") - 5000
    level = SC.running(e, ["n"], {"level": ("sum", cents), "errors": ("sum", (F.col("event_type") == "error").cast("long"))})
    peaks = SC.running(level, ["n"], {"peak": ("max", F.col("level"))})
    bought = SC.running(peaks, ["n"], {"last_purchase": ("last", F.when(F.col("event_type") == "purchase", F.col("event_id")))}, strictly=True)
    return bought.select("event_id", "n", "level", (F.greatest(F.lit(0), "peak") - F.col("level")).alias("below_peak"), "errors", "last_purchase")


@query("events_running_by_user", """SELECT event_id, user_id, row_number() OVER w AS n, (sum(round(value * 100)::BIGINT) OVER w)::BIGINT AS spent, max(value) OVER w AS most, lag(value, 2) OVER w AS second_before
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def events_running_by_user(spark, sf):
    """The same kept apart by user: a user with most events is dealt to all tasks like any other."""
    e = table(spark, sf, "events").select("ts", "event_id", "user_id", "value")
    by = ("user_id",)
    sums = SC.running(SC.numbered(e, ORDER, by), ORDER, {"spent": ("sum", F.round(F.col("value") * 100).cast("long")), "most": ("max", F.col("value"))}, by)
    found = SC.framed(sums, ORDER, 2, 0, lambda w: {"second_before": F.lag("value", 2).over(w)}, by)
    return found.select("event_id", "user_id", "n", "spent", "most", "second_before")


@query("events_block_sums", f"{_E}, d AS (SELECT t, n, value FROM e UNION ALL SELECT t + n, n, value FROM e WHERE t < 249) SELECT t, {q6('s', 's')} FROM (SELECT t, n, sum(value) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND 249 FOLLOWING) AS s FROM d) WHERE t < n")
def events_block_sums(spark, sf):
    """Sums of 250 consecutive events, the last ones going on with the first."""
    numbers = SC.numbered(events(spark, sf), ORDER, (), "t")
    return R.circular_block_sums(numbers, "value", 250, "t").select("t", r6("s", "s"))


_EZ = _E + ", z AS (SELECT t, value - avg(value) OVER () AS z FROM e)"


@query("events_autocov", f"{_EZ} SELECT k::INTEGER AS lag, {q6('sum(x.z * y.z) / min(m.n)', 'gamma')} FROM range(0, {LAGS + 1}) r(k) JOIN z x ON true JOIN z y ON y.t = x.t - k CROSS JOIN (SELECT count(*) AS n FROM z) m GROUP BY 1")
def events_autocov(spark, sf):
    return ST.autocovariances(events(spark, sf), "value", ORDER, LAGS).select("lag", r6("gamma", "gamma"))


@query("events_lrv_bartlett", " UNION ALL ".join([f"{_EZ} SELECT 5 AS lags, {q6(_omega(5), 'omega')}", f"SELECT {LAGS}, {q6(_omega(LAGS), 'omega')}"]))
def events_lrv_bartlett(spark, sf):
    """Long-run variances by two widths, from one pass of lags."""
    g = ST.autocovariances(events(spark, sf), "value", ORDER, LAGS)
    weight = lambda m: F.when(F.col("lag") == 0, 1.0).when(F.col("lag") <= m, 2 * (1 - F.col("lag") / (m + 1.0))).otherwise(0.0)
    one = g.agg(*[F.greatest(F.lit(0.0), F.sum(weight(m) * F.col("gamma"))).alias(f"w{m}") for m in (5, LAGS)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("lags"), r6(f"w{m}", "omega")) for m in (5, LAGS)])).alias("x")).select("x.*")


_EY = _E + ", y AS (SELECT t, value AS v, before FROM (SELECT *, lag(value) OVER (ORDER BY t) AS before FROM e) WHERE before IS NOT NULL)"


@query("events_hac", f"""{_EY}, f AS (SELECT regr_slope(v, before) AS b, regr_intercept(v, before) AS a, avg(before) AS m, sum(power(before - (SELECT avg(before) FROM y), 2)) AS sxx FROM y),
z AS (SELECT t, (v - a - b * before) * (before - m) AS z FROM y, f) SELECT {q6('b', 'slope')}, {q6('sqrt((SELECT count(*) FROM y) * ' + _omega(LAGS) + ') / sxx', 'se')} FROM f""")
def events_hac(spark, sf):
    """Each event's value on that of the event before, with errors robust to autocorrelation."""
    y = SC.framed(events(spark, sf), ORDER, 1, 0, lambda w: {"before": F.lag("value").over(w)}).where("before IS NOT NULL")
    fit = ST.ols(y, "value", ["before"], ORDER, LAGS)
    return spark.createDataFrame([(float(fit.beta[1]), float(fit.se()[1]))], "slope double, se double").select(r6("slope", "slope"), r6("se", "se"))


_F = "lag(x, 1) OVER (ORDER BY t)"


@query("events_cum_qlike", f"""{_E}, x AS (SELECT event_id, t, x, {_F} AS m, avg(x) OVER (ORDER BY t ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS f FROM (SELECT *, value + 1 AS x FROM e))
SELECT event_id, {q6('sum((x / m - ln(x / m)) - (x / f - ln(x / f))) OVER (ORDER BY t)', 'gain')} FROM x WHERE m IS NOT NULL""")
def events_cum_qlike(spark, sf):
    """Running gain of the mean of the last hundred events over the last event alone as a forecast of the next value."""
    x = F.col("value") + 1
    e = events(spark, sf).withColumn("x", x)
    known = SC.framed(e, ORDER, 100, 0, lambda w: {"m": F.lag("x").over(w), "f": F.avg("x").over(w.rowsBetween(-100, -1))}).where("m IS NOT NULL")
    gain = L.qlike(F.col("x"), F.col("m")) - L.qlike(F.col("x"), F.col("f"))
    return SC.running(known, ORDER, {"gain": ("sum", gain)}).select("event_id", r6("gain", "gain"))


_HOURS = """WITH grid AS (SELECT event_type, h FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest(generate_series(min(date_trunc('hour', ts)), max(date_trunc('hour', ts)), INTERVAL '1 hour')) AS h FROM events)),
hours AS (SELECT g.event_type, g.h, count(e.ts) AS x, coalesce(sum(round(e.value * 100)::BIGINT), 0)::BIGINT AS y FROM grid g LEFT JOIN events e ON e.event_type = g.event_type AND date_trunc('hour', e.ts) = g.h GROUP BY 1, 2),
mixed AS (SELECT event_type, h, x, y % 1009 AS y FROM hours),
ranked AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY h) - 1 AS t, count(*) OVER (PARTITION BY event_type) AS n,
  2 * rank() OVER (PARTITION BY event_type ORDER BY x) + count(*) OVER (PARTITION BY event_type, x) - 1 - count(*) OVER (PARTITION BY event_type) - 1 AS x,
  2 * rank() OVER (PARTITION BY event_type ORDER BY y) + count(*) OVER (PARTITION BY event_type, y) - 1 - count(*) OVER (PARTITION BY event_type) - 1 AS y FROM mixed)"""


def hourly(spark, sf):
    """(event_type, h, x, y) of every hour from the first to the last: how many events, and their cents modulo 1009."""
    e = table(spark, sf, "events").select("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    first, last = e.agg(F.min("h"), F.max("h")).head()
    kinds = e.select("event_type").distinct()
    grid = kinds.withColumn("h", F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("INTERVAL 1 HOUR"))))
    sums = e.groupBy("event_type", "h").agg(F.count("*").alias("x"), F.sum("cents").alias("y"))
    found = grid.join(sums, ["event_type", "h"], "left")
    return found.select("event_type", "h", F.coalesce("x", F.lit(0)).alias("x"), (F.coalesce("y", F.lit(0)) % 1009).alias("y"))


@query("shift_perm_all", f"""{_HOURS}, c AS (SELECT a.event_type, a.n, (b.t - a.t + a.n) % a.n AS s, sum(a.x * b.y) AS c, sqrt(sum(a.x * a.x)::DOUBLE * sum(b.y * b.y)::DOUBLE) AS scale FROM ranked a JOIN ranked b USING (event_type) GROUP BY ALL),
z AS (SELECT event_type, c AS c0, scale FROM c WHERE s = 0)
SELECT event_type, n, {q6('any_value(CASE WHEN z.scale > 0 THEN c0 / z.scale END)', 'rho')}, count(*) FILTER (s > 0 AND abs(c) >= abs(c0)) AS reached, {q6('(1 + count(*) FILTER (s > 0 AND abs(c) >= abs(c0))) / n::DOUBLE', 'p')}
FROM c JOIN z USING (event_type) GROUP BY event_type, n""")
def shift_perm_all(spark, sf):
    """Rank correlation of hourly counts and sums by event type, against every circular shift."""
    found = SH.shift_test(hourly(spark, sf), "event_type", ["h"], "x", "y")
    return found.select("event_type", "n", r6("rho", "rho"), "reached", r6("p", "p"))


#: Rows of the frames by user and over all events, and the quantiles asked for.
FRAME, FRAME_ALL, QUANTILES = 10_000, 1_000, (0.1, 0.5, 0.9)


def _order_sql(partition: str, length: int) -> str:
    frame = f"({partition} ORDER BY ts, event_id ROWS BETWEEN {length} PRECEDING AND 1 PRECEDING)"
    quantiles = ", ".join(q6(f"quantile_cont(value, {q}) OVER w", f"q{round(q * 100)}") for q in QUANTILES)
    seen = "list(value) OVER w AS seen"
    return f"""SELECT event_id, coalesce(len(seen), 0)::BIGINT AS n_known, coalesce(len(list_filter(seen, lambda x: x < value)), 0)::BIGINT AS n_below,
coalesce(len(list_filter(seen, lambda x: x = value)), 0)::BIGINT AS n_equal, * EXCLUDE (event_id, seen, value) FROM (SELECT event_id, value, {seen}, {quantiles} FROM events WINDOW w AS {frame})"""


def _ordered(spark, sf, length, by):
    e = table(spark, sf, "events").select("ts", "event_id", "user_id", "value")
    found = OS.rolling_order(e, ORDER, F.col("value"), length, by, QUANTILES)
    return found.select("event_id", "n_known", "n_below", "n_equal", *[r6(F.col("quantiles")[k], f"q{round(q * 100)}") for k, q in enumerate(QUANTILES)])


@query("rolling_order_by_user", _order_sql("PARTITION BY user_id", FRAME))
def rolling_order_by_user(spark, sf):
    """Each event's rank among the user's last ten thousand, and their quantiles."""
    return _ordered(spark, sf, FRAME, ("user_id",))


@query("rolling_order_all", _order_sql("", FRAME_ALL))
def rolling_order_all(spark, sf):
    """The same among the last thousand events of all."""
    return _ordered(spark, sf, FRAME_ALL, ())


DAY, HOUR = 86_400_000_000, 3_600_000_000


def _covered_sql(partition: str, span: str, micros: int, gap: int) -> str:
    return f"""WITH x AS (SELECT *, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER ({partition} ORDER BY ts, event_id) - epoch_us(ts) AS d FROM events),
f AS (SELECT event_id, count(*) OVER w AS n, coalesce(greatest(max(d) OVER w, min(t) OVER w - (t - {micros})), {micros}) AS widest, (sum(round(value * 100)::BIGINT) OVER w)::BIGINT AS cents, max(value) OVER w AS most
  FROM x WINDOW w AS ({partition} ORDER BY ts RANGE BETWEEN INTERVAL {span} PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))
SELECT event_id, n, widest, CASE WHEN widest <= {gap} AND n > 0 THEN cents END AS cents, CASE WHEN widest <= {gap} AND n > 0 THEN most END AS most FROM f"""


def _covered(spark, sf, span, gap, by):
    e = table(spark, sf, "events").select("ts", "event_id", "user_id", "value")
    found = SC.covered_frames(e, "ts", span, gap, {"cents": ("sum", F.round(F.col("value") * 100).cast("long")), "most": ("max", F.col("value"))}, ("event_id",), by)
    return found.select("event_id", "n", "widest", "cents", "most")


@query("range_frame_6h", _covered_sql("", "6 HOUR", 6 * HOUR, 30 * HOUR // 60))
def range_frame_6h(spark, sf):
    """The six hours before each event, null where half an hour of them has none."""
    return _covered(spark, sf, 6 * HOUR, 30 * HOUR // 60, ())


@query("range_frame_4d_by_user", _covered_sql("PARTITION BY user_id", "4 DAY", 4 * DAY, 2 * DAY))
def range_frame_4d_by_user(spark, sf):
    """A user's four days before each event, null where two days of them have none."""
    return _covered(spark, sf, 4 * DAY, 2 * DAY, ("user_id",))
