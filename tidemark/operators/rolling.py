"""Rolling and causal windows over ledgers.

Many series are kept apart by ``by``. Windows of ``ordered`` without it are for ledgers, which have a row a day; sums that
wrap around take series of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from .scan import framed, numbered

#: A drawdown deeper than rounding.
DRAWN = 1e-9


def ordered(on: str | tuple[str, ...], by: tuple[str, ...] = ()) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*([on] if isinstance(on, str) else on))


def full(value: Column, count: Column, n: int) -> Column:
    """The value where its frame holds n values, else null."""
    return F.when(count >= n, value)


def prior(c: Column, n: int, how: str, order: WindowSpec, at_least: int | None = None) -> Column:
    """An aggregate (median, mean, std, sum) of the n rows before the current one; null values don't count."""
    frame = order.rowsBetween(-n, -1)
    f = {"median": lambda: F.percentile(c, 0.5), "mean": lambda: F.avg(c), "std": lambda: F.stddev_samp(c), "sum": lambda: F.sum(c)}[how]()
    return full(f.over(frame), F.count(c).over(frame), n if at_least is None else at_least)


def causal_lag(rows: DataFrame, value: str, date: str = "date", most_days: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """rows with lag_date and lag_value: the latest known value strictly before, null if it is older than most_days."""
    before = ordered(date, by).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(date).alias("d"), F.col(value).alias("v"))), ignorenulls=True).over(before)
    fresh = F.datediff(F.col(date), F.col("_last")["d"]) <= most_days
    return rows.withColumn("_last", last).withColumns({"lag_date": F.when(fresh, F.col("_last")["d"]), "lag_value": F.when(fresh, F.col("_last")["v"])}).drop("_last")


def runs(rows: DataFrame, flag: Column, on: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Islands of consecutive rows with the flag: (by, first, last, length)."""
    w = ordered(on, by)
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(*by, "_flag").orderBy(on))
    marked = rows.withColumn("_flag", F.coalesce(flag, F.lit(False))).withColumn("_island", island).where("_flag")
    return marked.groupBy(*by, "_island").agg(F.min(on).alias("first"), F.max(on).alias("last"), F.count("*").alias("length")).drop("_island")


def equity(trades: DataFrame, fraction: Column, on: str = "n", by: tuple[str, ...] = ()) -> DataFrame:
    """trades with equity, peak and drawdown of compounding fraction * r; the peak starts at the initial equity, 1."""
    upto = ordered(on, by).rowsBetween(Window.unboundedPreceding, 0)
    e = F.exp(F.sum(F.log1p(fraction * F.col("r"))).over(upto))
    out = trades.withColumn("equity", e)
    return out.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(upto))).withColumn("drawdown", 1 - F.col("equity") / F.col("peak"))


def braked(base: float = 0.01, on: str = "n", by: tuple[str, ...] = ()) -> Column:
    """Half the risk after 20 trades whose sum of R is under -4; it depends on R alone, so no recursion."""
    frame = ordered(on, by).rowsBetween(-20, -1)
    low = (F.count("r").over(frame) >= 20) & (F.round(F.sum("r").over(frame), 9) < -4)
    return F.when(low, base / 2).otherwise(base)


def circular_block_sums(rows: DataFrame, value: str, block: int, on: str = "t") -> DataFrame:
    """(t, s, n): sums of block consecutive values, wrapping around; t is 0 .. n - 1."""
    return circular_sums(rows.withColumn("_s", F.col(value)), ["_s"], block, on).withColumnRenamed("_s", "s").select("t", "s", "n")


def circular_sums(rows: DataFrame, values: list[str], block: int, on: str = "t") -> DataFrame:
    """(t, values, n): sums of block consecutive values of each column, wrapping around; unknown values don't count.

    The series is dealt by ranges with halos; its last rows see copies of its first."""
    first = numbered(rows.select(on, *values), [on], (), "_n").withColumn("t", F.col("_n") - 1)
    n = rows.count()
    sums = framed(first.select("t", *values), ["t"], 0, max(block - 1, 0), lambda w: {f"_s{k}": F.sum(c).over(w.rowsBetween(0, block - 1)) for k, c in enumerate(values)}, wrap=True)
    return sums.select("t", F.lit(n).cast("long").alias("n"), *[F.col(f"_s{k}").alias(c) for k, c in enumerate(values)])
