"""Moments, ranks and quantile buckets as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import temporary


def skew_corrected(c: Column) -> Column:
    """Bias-corrected skewness from the biased one that Spark computes."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1.0)) / (n - 2))


def kurtosis_corrected(c: Column) -> Column:
    """Bias-corrected excess kurtosis."""
    n = F.count(c)
    return F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * F.kurtosis(c) + 6))


#: Rows whose values one task may sort or hold.
BOUND = 1_000_000
PARTS = 64


def cumulated(rows: DataFrame, column: str, bound: int = BOUND) -> DataFrame:
    """(column, n, upto): each known value, how often it occurs, and how many rows have it or less.

    Beyond bound rows the values are dealt by an approximate quantile of bounded size to PARTS tasks, which sort their own;
    only one sum a task goes through a window without a partition.
    """
    known = rows.select(column).where(F.col(column).isNotNull())
    values = known.groupBy(column).agg(F.count("*").alias("n"))
    if rows.count() <= bound:
        upto = Window.orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
        return values.withColumn("upto", F.sum("n").over(upto))
    edges = known.agg(F.percentile_approx(column, F.array(*[F.lit(k / PARTS) for k in range(1, PARTS)]), F.lit(10_000))).head()[0]
    part = F.lit(0)
    for e in sorted(set(edges or ())):
        part = part + (F.col(column) > F.lit(e)).cast("int")
    dealt = values.withColumn("_part", part)
    inside = Window.partitionBy("_part").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    sums = dealt.groupBy("_part").agg(F.sum("n").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # At most PARTS rows.
    return dealt.withColumn("_in", F.sum("n").over(inside)).join(F.broadcast(sums), "_part").select(column, "n", (F.col("_before") + F.col("_in")).alias("upto"))


def average_rank(rows: DataFrame, column: str, name: str, bound: int = BOUND) -> DataFrame:
    """rows with the rank of a column, ties sharing their mean rank; null for null.

    Ranks join rows by value, so rows are stored first: computed anew, a sum may come out with other last bits."""
    rows = temporary(rows, "rows-to-rank")
    ranks = cumulated(rows, column, bound).select(column, (F.col("upto") - (F.col("n") - 1) / 2.0).alias(name))
    return rows.join(ranks, column, "left")


def exact_quantiles(rows: DataFrame, column: str, at: list[float], bound: int = BOUND) -> list[float | None]:
    """Quantiles by linear interpolation, exact however many rows: two known ranks each reach the driver."""
    values = cumulated(rows, column, bound)
    n = rows.where(F.col(column).isNotNull()).count()
    if not n:
        return [None] * len(at)
    wanted = sorted({int(f(q * (n - 1))) for q in at for f in (math.floor, math.ceil)})
    rank = F.explode(F.array(*map(F.lit, wanted)))
    found = values.withColumn("_rank", rank).where((F.col("_rank") >= F.col("upto") - F.col("n")) & (F.col("_rank") < F.col("upto")))
    value = {r["_rank"]: float(r[column]) for r in found.select("_rank", column).collect()}
    low, high = ([value[int(f(q * (n - 1)))] for q in at] for f in (math.floor, math.ceil))
    return [a + (b - a) * (q * (n - 1) - math.floor(q * (n - 1))) for q, a, b in zip(at, low, high)]


def quantile_edges(rows: DataFrame, column: str, parts: int) -> list[float]:
    """The inner edges of equal-frequency buckets, by linear interpolation: parts - 1 numbers."""
    return exact_quantiles(rows, column, [k / parts for k in range(1, parts)])


def bucket(c: Column, edges: list[float]) -> Column:
    """1 .. len(edges) + 1, right-closed; equal edges leave buckets empty."""
    out = F.when(c.isNull(), F.lit(None).cast("int"))
    for k, e in enumerate(edges, 1):
        out = out.when(c <= e, k)
    return out.otherwise(len(edges) + 1)
