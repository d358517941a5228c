"""Regression, autocorrelation-robust inference, bootstrap by relational joins, and interval formulas.

Cross-products are one aggregate pass; what comes to the driver is a matrix of (k + 1) squared numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import framed

NORMAL = NormalDist()


def lagged(rows: DataFrame, on: str | list[str], columns: list[str], lags: int) -> DataFrame:
    """columns and their values of 1 .. lags rows before as c_1, c_2 ...: dealt by ranges of the order, with halos."""
    order = [on] if isinstance(on, str) else on
    names = {f"{c}_{k}": (c, k) for c in columns for k in range(1, lags + 1)}
    found = framed(rows, order, lags, 0, lambda w: {name: F.lag(c, k).over(w) for name, (c, k) in names.items()})
    return found.select(*columns, *names)


def autocovariances(rows: DataFrame, value: str, on: str | list[str], lags: int) -> DataFrame:
    """(lag, gamma) for 0 .. lags with divisor n: lagged products in one pass, one aggregate."""
    mean = rows.agg(F.avg(value)).head()[0]
    order = [on] if isinstance(on, str) else on
    z = lagged(rows.select(*order, (F.col(value) - F.lit(mean)).alias("z")), order, ["z"], lags)
    sums = z.agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("z")).alias("s0"), *[F.sum(F.col("z") * F.col(f"z_{k}")).alias(f"s{k}") for k in range(1, lags + 1)])
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), (F.coalesce(F.col(f"s{k}"), F.lit(0.0)) / F.col("n")).alias("gamma")) for k in range(lags + 1)])
    return sums.where("n > 0").select(F.explode(pairs).alias("p")).select("p.*")


def bartlett_lrv(rows: DataFrame, value: str, on: str | list[str], lags: int) -> DataFrame:
    """(omega): long-run variance with Bartlett weights, floored at 0."""
    g = autocovariances(rows, value, on, lags)
    weight = F.when(F.col("lag") == 0, 1.0).otherwise(2 * (1 - F.col("lag") / (lags + 1.0)))
    return g.agg(F.greatest(F.lit(0.0), F.sum(weight * F.col("gamma"))).alias("omega"))


@dataclass(frozen=True)
class Fit:
    names: tuple[str, ...]
    beta: np.ndarray
    covariance: np.ndarray
    n: int
    r2: float

    def se(self) -> np.ndarray:
        return np.sqrt(np.diag(self.covariance))

    def rows(self) -> list[tuple]:
        """(term, beta, se, t, p, ci_low, ci_high) with normal quantiles."""
        out, z = [], NORMAL.inv_cdf(0.975)
        for name, b, s in zip(self.names, self.beta, self.se()):
            t = b / s if s > 0 else None
            out.append((name, float(b), float(s), None if t is None else float(t), None if t is None else 2 * (1 - NORMAL.cdf(abs(t))), float(b - z * s), float(b + z * s)))
        return out


def gram(rows: DataFrame, outcome: str, regressors: list[str]) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X, X'y, y'y and n of complete rows, in one partial aggregate."""
    rows = rows.dropna(subset=[outcome, *regressors])
    cols = [F.lit(1.0), *[F.col(c) for c in regressors], F.col(outcome)]
    k = len(cols)
    sums = rows.agg(*[F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)], F.count("*").alias("n")).head()
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = sums[f"s{i}_{j}"] or 0.0
    return m[:-1, :-1], m[:-1, -1], float(m[-1, -1]), int(sums["n"])


def ols(rows: DataFrame, outcome: str, regressors: list[str], on: str | list[str] | None = None, hac_lags: int | None = None) -> Fit:
    """Least squares with an intercept; the covariance is HAC (Bartlett, no small-sample correction) if lags are given."""
    xx, xy, yy, n = gram(rows, outcome, regressors)
    beta = np.linalg.solve(xx, xy)
    residual_ss = yy - beta @ xy
    total_ss = yy - xy[0] ** 2 / n
    bread = np.linalg.inv(xx)
    if hac_lags is None:
        cov = bread * residual_ss / max(n - len(beta), 1)
    else:
        meat = _hac_meat(rows.dropna(subset=[outcome, *regressors]), outcome, regressors, beta, on, hac_lags)
        cov = bread @ meat @ bread
    return Fit(("const", *regressors), beta, cov, n, 1 - residual_ss / total_ss if total_ss else math.nan)


def _hac_meat(rows: DataFrame, outcome: str, regressors: list[str], beta: np.ndarray, on: str | list[str], lags: int) -> np.ndarray:
    fitted = F.lit(float(beta[0]))
    for b, c in zip(beta[1:], regressors):
        fitted = fitted + float(b) * F.col(c)
    e = F.col(outcome) - fitted
    k = len(beta)
    order = [on] if isinstance(on, str) else on
    scores = rows.select(*order, *[(x * e).alias(f"u{i}") for i, x in enumerate([F.lit(1.0), *[F.col(c) for c in regressors]])])
    near = lagged(scores, order, [f"u{i}" for i in range(k)], lags)
    aggs = [F.sum(F.col(f"u{i}") * F.col(f"u{j}" if q == 0 else f"u{j}_{q}")).alias(f"s{q}_{i}_{j}") for q in range(lags + 1) for i in range(k) for j in range(k)]
    row = near.agg(*aggs).head()
    meat = np.zeros((k, k))
    for q in range(lags + 1):
        g = np.array([[row[f"s{q}_{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)])
        meat += g if q == 0 else (1 - q / (lags + 1)) * (g + g.T)
    return meat


def benjamini_hochberg(tests: DataFrame, p: str = "p") -> DataFrame:
    """tests with q: the running minimum of p * n / rank from the largest p down."""
    order = Window.orderBy(p)
    ranked = tests.withColumns({"_rank": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy())})
    scaled = ranked.withColumn("_raw", F.col(p) * F.col("_n") / F.col("_rank"))
    below = order.rowsBetween(0, Window.unboundedFollowing)
    return scaled.withColumn("q", F.least(F.lit(1.0), F.min("_raw").over(below))).drop("_rank", "_n", "_raw")


def wilson(k: Column, n: Column, z: float, upper: bool) -> Column:
    p = k / n
    middle = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (middle + half if upper else middle - half) / (1 + z * z / n)


def circular_draws(n: int, block: int, draws: int, spark, seed: int = 1) -> DataFrame:
    """(draw, start) of the blocks of each draw: starts are hashes, so every engine draws the same."""
    blocks = -(-n // block)
    text = F.concat_ws(":", F.lit(seed), F.col("draw"), F.col("k"))
    start = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n
    return spark.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("k")).select("draw", "k", start.alias("start"))


def drawn_sums(rows: DataFrame, values: list[str], on: str, block: int, draws: int, seed: int = 1) -> DataFrame:
    """(draw, values): sums of each column over resampled series of circular blocks, the last one cut to the length."""
    from ..operators.rolling import circular_sums

    n = rows.count()
    d, whole = circular_draws(n, block, draws, rows.sparkSession, seed), n // block

    def joined(width: int, which: Column) -> DataFrame:
        return d.where(which).join(circular_sums(rows, values, width, on), F.col("start") == F.col("t")).select("draw", *values)

    parts = joined(block, F.col("k") < whole)
    if n % block:
        parts = parts.unionByName(joined(n % block, F.col("k") == whole))
    return parts.groupBy("draw").agg(*[F.sum(c).alias(c) for c in values])


def bootstrap_coefficients(rows: DataFrame, outcome: str, regressors: list[str], target: str, on: str, block: int = 5, draws: int = 2000) -> DataFrame:
    """(draw, beta): the target's coefficient in resampled regressions with an intercept, from resampled cross-products.

    A draw whose regressors don't vary has a null coefficient."""
    import pandas as pd

    names = ["one", *regressors, outcome]
    base = rows.dropna(subset=[outcome, *regressors]).withColumn("one", F.lit(1.0))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    products = base.select(on, *[(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs])
    sums = drawn_sums(products, [f"p{i}_{j}" for i, j in pairs], on, block, draws)
    k, at = len(names) - 1, names.index(target)

    def solve(frames):
        for f in frames:
            g = np.zeros((len(f), k + 1, k + 1))
            for i, j in pairs:
                g[:, i, j] = g[:, j, i] = f[f"p{i}_{j}"]
            beta = np.full(len(f), np.nan)
            good = np.linalg.matrix_rank(g[:, :k, :k], hermitian=True) == k
            beta[good] = np.linalg.solve(g[good][:, :k, :k], g[good][:, :k, k:])[:, at, 0]
            yield pd.DataFrame({"draw": f["draw"], "beta": beta})

    return sums.mapInPandas(solve, "draw long, beta double").withColumn("beta", F.when(~F.isnan("beta"), F.col("beta")))
