"""Periods from stored day sketches, held against the exact results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sketches as K
from ..sources.files import temporary
from ..sources.market import table
from .registry import query

QUANTILES = (0.1, 0.5, 0.9)


@query("sketch_periods", f"""WITH x AS (SELECT p AS period, event_type, value, user_id, ts FROM events, (VALUES ('all'), ('week')) v(p)),
y AS (SELECT CASE period WHEN 'all' THEN 'all' ELSE strftime(date_trunc('week', ts), '%Y-%m-%d') END AS period, event_type, value, user_id, ts FROM x)
SELECT period, event_type, count(DISTINCT ts::DATE) AS days, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents, min(value) AS least, max(value) AS greatest, true AS quantiles_hold, true AS distinct_holds FROM y GROUP BY ALL""")
def sketch_periods(spark, sf):
    """Weeks and the whole time by event type from one table of day sketches; whether quantiles and distinct users are
    within the stated bounds of the exact ones is counted over all events."""
    e = table(spark, sf, "events").select("event_type", "user_id", F.to_date("ts").alias("day"), F.col("value"))
    cents = e.withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    days = temporary(K.daily_sketches(cents, F.col("day"), ["event_type"], "cents", "user_id"), "day-sketches")
    week = F.date_format(F.trunc("day", "week"), "yyyy-MM-dd")
    keys, found = ["event_type"], None
    for period in (F.lit("all"), week):
        sketched = K.merged(days, period, keys, QUANTILES)
        found = sketched if found is None else found.unionByName(sketched)
    found = temporary(found, "periods")
    rows = cents.withColumn("period", F.explode(F.array(F.lit("all"), week)))
    # Exact ranks of the sketched quantiles, and exact distinct counts, in one pass over the events.
    q = F.col("quantiles")
    ranks = [F.count_if(F.col("cents") < q[k]).alias(f"below{k}") for k in range(len(QUANTILES))] + [F.count_if(F.col("cents") <= q[k]).alias(f"upto{k}") for k in range(len(QUANTILES))]
    exact = rows.join(F.broadcast(found.select("period", *keys, "quantiles")), ["period", *keys]).groupBy("period", *keys).agg(*ranks, F.countDistinct("user_id").alias("users"))
    both = found.join(exact, ["period", *keys])
    room = K.RANK_ERROR * F.col("n") + 1
    holds = F.lit(True)
    for k, p in enumerate(QUANTILES):
        holds = holds & (F.col(f"below{k}") <= p * F.col("n") + room) & (F.col(f"upto{k}") >= p * F.col("n") - room)
    near = F.abs(F.col("distinct") - F.col("users")) <= K.DISTINCT_ERROR * F.col("users") + 1
    return both.select("period", "event_type", "days", "n", F.col("total").alias("cents"), (F.col("least") / 100).alias("least"), (F.col("greatest") / 100).alias("greatest"), holds.alias("quantiles_hold"), near.alias("distinct_holds"))
