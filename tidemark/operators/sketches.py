"""Sketches of each day, stored once and merged for any period.

A day and key have one row: a count, sum, least and greatest value, which are exact; a KLL sketch of the values for
quantiles; a HyperLogLog sketch for distinct ids. A period reads its days' rows, never the events again, and merges them
with the sketches' own union. What the results may be off by follows from the sketches' sizes: the rank of a quantile by
RANK_ERROR at most and a distinct count by DISTINCT_ERROR, each with 99 % confidence or better.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of HyperLogLog's registers, and of KLL's size.
HLL_LOG_K, KLL_K = 12, 400
#: Three standard errors of HyperLogLog at that size (1.04 / sqrt(4096)).
DISTINCT_ERROR = 3 * 1.04 / 64
#: KLL's normalised rank error at that size, with some room: 0.7 % for a single quantile at 99 %.
RANK_ERROR = 0.01


def daily_sketches(rows: DataFrame, day: Column, keys: list[str], value: str, ident: str) -> DataFrame:
    """(day, keys, n, total, least, greatest, quantiles, ids): partial sketches in each task, merged once a day and key."""
    return rows.groupBy(day.alias("day"), *keys).agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("greatest"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("quantiles"), F.hll_sketch_agg(ident, F.lit(HLL_LOG_K)).alias("ids"),
    )


def merged(days: DataFrame, period: Column, keys: list[str], quantiles: tuple[float, ...]) -> DataFrame:
    """(period, keys, days, n, total, least, greatest, quantiles, distinct) from the days of each period."""
    one = days.groupBy(period.alias("period"), *keys).agg(
        F.count("*").alias("days"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.kll_merge_agg_double("quantiles", F.lit(KLL_K)).alias("_q"), F.hll_union_agg("ids").alias("_ids"),
    )
    found = F.array(*[F.kll_sketch_get_quantile_double("_q", F.lit(q)) for q in quantiles])
    return one.select("period", *keys, "days", "n", "total", "least", "greatest", found.alias("quantiles"), F.hll_sketch_estimate("_ids").alias("distinct"))
