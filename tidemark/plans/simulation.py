"""Simulation queries: generators, measures, calibration, audits. Their seeds are fixed; they have no SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions.stats import NORMAL
from ..operators import simulate as SIM
from ..sources.market import daily
from .registry import query
from .rolling import valid
from .views import r6

#: The reference's design.
FULL = SIM.Design(burn=500, train=400, scored=8000, sizes=(250, 500, 1000, 2000, 4000, 8000))
NULL_PATHS, EFFECT_PATHS = 2000, 1000
#: Effects are calibrated on longer training, in block 10 and 16 paths a multiplier.
CALIBRATION = SIM.Design(burn=500, train=4000, scored=8000, sizes=FULL.sizes)
#: Fixed values of the planning: draws a block of the bound on the long-run variance, its lags and reserve; power targets,
#: the effect, and draws of the conditional power.
LRV_DRAWS, LRV_LAGS, LRV_RESERVE = 2000, (5, 10, 20), 1.5
POWER_TARGETS, PLANNED_EFFECT, POWER_DRAWS = (0.8, 0.9), 0.05, 20_000
MULTIPLIERS, CALIBRATION_PATHS = (0.0, 0.125, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), 16


def _pilot(spark, sf):
    return SIM.pilot(daily(spark, sf))


@query("block_indices", "SELECT path, t, (CAST('0x' || substr(md5('3:' || path || ':' || (t // 5)), 1, 8) AS BIGINT) % 500 + t % 5) % 500 AS index FROM range(0, 50) p(path), range(0, 42) q(t)")
def block_indices(spark, sf):
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(3), F.col("path"), F.floor(F.col("t") / 5))), 1, 8), 16, 10).cast("long") % 500
    p = spark.range(50).select(F.col("id").alias("path"), F.explode(F.sequence(F.lit(0), F.lit(41)).cast("array<bigint>")).alias("t"))
    return p.select("path", "t", ((start + F.col("t") % 5) % 500).alias("index"))


@query("pilot_fit", None)
def pilot_fit(spark, sf):
    p = _pilot(spark, sf)
    rows = [(name, k, float(v), float(p["fitted"][name][k])) for name in ("ca", "cl", "cr") for k, v in enumerate(p[name])]
    rows += [("theta", 0, p["theta"], p["theta"]), ("residuals", 0, float(len(p["residuals"])), float(len(p["residuals"])))]
    return spark.createDataFrame(rows, "part string, k int, value double, fitted double")


_SHOWN = ["phase", "block", "effect", "path", "n", "statistic", "mean_gain", "gain", "mse_ratio", "mae_ratio", "coefficient"]


@query("dgp_reduced", None)
def dgp_reduced(spark, sf):
    return SIM.simulate(spark, _pilot(spark, sf), FULL, [("null", 5, 0.0, NULL_PATHS), ("effect", 5, 1.0, EFFECT_PATHS)], coherent=False).select(*_SHOWN)


@query("dgp_coherent", None)
def dgp_coherent(spark, sf):
    return SIM.simulate(spark, _pilot(spark, sf), FULL, [("null", 10, 0.0, NULL_PATHS), ("effect", 10, 1.0, EFFECT_PATHS)]).select(*_SHOWN)


@query("sim_forecasts", None)
def sim_forecasts(spark, sf):
    rows = SIM.simulate(spark, _pilot(spark, sf), FULL, [("effect", 5, 1.0, EFFECT_PATHS)]).where(F.col("n") == FULL.sizes[-1])
    return rows.groupBy("block").agg(F.count("*").alias("paths"), F.avg("gain").alias("mean_gain"), F.avg((F.col("coefficient") > 0).cast("double")).alias("positive"), F.avg("mse_ratio").alias("mse_ratio"), F.avg("mae_ratio").alias("mae_ratio"))


@query("sim_measure", None)
def sim_measure(spark, sf):
    cells = [("null", b, 0.0, NULL_PATHS) for b in FULL.blocks] + [("effect", b, 1.0, EFFECT_PATHS) for b in FULL.blocks]
    return SIM.simulate(spark, _pilot(spark, sf), FULL, cells).select(*_SHOWN)


def _criticals(spark, p):
    """A few rows, computed before any path that they judge is drawn."""
    rows = SIM.simulate(spark, p, FULL, [("null_calibration", b, 0.0, NULL_PATHS) for b in FULL.blocks])
    return spark.createDataFrame(SIM.calibrated(rows).collect(), "n int, critical double")


def _effects(spark, p):
    """(target, multiplier), a few rows."""
    rows = SIM.simulate(spark, p, CALIBRATION, [("grid", 10, m, CALIBRATION_PATHS) for m in MULTIPLIERS])
    return SIM.interpolated(SIM.achieved(rows, CALIBRATION))


@query("sim_summarize", None)
def sim_summarize(spark, sf):
    """Critical values from null paths, then the size on other null paths and the power at each calibrated effect."""
    p = _pilot(spark, sf)
    effects = {r["multiplier"]: r["target"] for r in _effects(spark, p).collect()}
    cells = [("null_validation", b, 0.0, NULL_PATHS) for b in FULL.blocks]
    cells += [("alternative", b, m, EFFECT_PATHS) for m in sorted(effects) for b in FULL.blocks]
    named = spark.createDataFrame([(0.0, 0.0), *((float(m), float(t)) for m, t in effects.items() if m)], "effect double, target_effect double")
    return SIM.summarise(SIM.simulate(spark, p, FULL, cells), _criticals(spark, p)).join(F.broadcast(named), "effect", "left")


@query("critical_calibration", None)
def critical_calibration(spark, sf):
    return _criticals(spark, _pilot(spark, sf))


@query("effect_calibration", None)
def effect_calibration(spark, sf):
    """The grid's achieved gains, and the multipliers that meet the targets."""
    rows = SIM.simulate(spark, _pilot(spark, sf), CALIBRATION, [("grid", 10, m, CALIBRATION_PATHS) for m in MULTIPLIERS])
    grid = spark.createDataFrame(SIM.achieved(rows, CALIBRATION).collect(), "multiplier double, achieved_gain double, mc_se double")
    met = SIM.interpolated(grid).select("target", "multiplier", F.col("target").alias("achieved_gain"), F.lit(None).cast("double").alias("mc_se"))
    return grid.select(F.lit(None).cast("double").alias("target"), "multiplier", "achieved_gain", "mc_se").unionByName(met)


@query("ordering_audit", None)
def ordering_audit(spark, sf):
    p = _pilot(spark, sf)
    one = lambda coherent, name: SIM.simulate(spark, p, FULL, [("null", 5, 0.0, NULL_PATHS)], coherent).where(F.col("n") == FULL.sizes[-1]).agg(F.avg("exceed").alias("share")).select(F.lit(name).alias("generator"), "share")
    return one(True, "coherent").unionByName(one(False, "reduced"))


_SLOPES = (2.0, 0.6, -0.5, 0.2, 0.1)
_MEANS = (-1.0, 0.5, -0.8, -0.9)


@query("slope_shrink", "SELECT k, before, round(CASE WHEN k = 0 THEN -0.7 - sum(CASE WHEN k > 0 THEN before * mean END) OVER () * 0.97 / 1.4 ELSE before * 0.97 / 1.4 END, 6) + 0.0 AS after FROM (VALUES (0, 2.0::DOUBLE, NULL::DOUBLE), (1, 0.6, -1.0), (2, -0.5, 0.5), (3, 0.2, -0.8), (4, 0.1, -0.9)) x(k, before, mean)")
def slope_shrink(spark, sf):
    """Slopes whose absolute sum is 1.4, of states with these means, for a target with mean -0.7."""
    after = SIM.shrunk(np.array(_SLOPES), np.array(_MEANS), -0.7)
    return spark.createDataFrame([(k, x, float(y)) for k, (x, y) in enumerate(zip(_SLOPES, after))], "k int, before double, after double").withColumn("after", r6("after"))


def _losses(spark, sf):
    """The daily ledger of paired differences, one row a day."""
    return np.array([r["a"] for r in valid(spark, sf).orderBy("date").select("a").collect()])


def omega(z: np.ndarray, lags: int) -> np.ndarray:
    """Long-run variance of each row with Bartlett weights, floored at 0."""
    z = z - z.mean(1, keepdims=True)
    n = z.shape[1]
    weights = [1.0] + [2 * (1 - k / (lags + 1)) for k in range(1, min(lags, n - 1) + 1)]
    return np.maximum(0, sum(w * (z[:, k:] * z[:, : n - k]).sum(1) / n for k, w in enumerate(weights)))


def _lrv_draws(spark, x):
    import pandas as pd

    shared = spark.sparkContext.broadcast(x - x.mean())

    def run(pdf):
        z, block, batch = shared.value, int(pdf["block"].iloc[0]), int(pdf["batch"].iloc[0])
        paths = batch * 50 + np.arange(min(50, LRV_DRAWS - batch * 50))
        s = z[SIM.circular_positions((17, block), paths, len(z), block, len(z))]
        return pd.DataFrame({"block": block, "draw": paths, "omega": np.max([omega(s, k) for k in LRV_LAGS], axis=0)})

    jobs = spark.createDataFrame([(b, k) for b in FULL.blocks for k in range(-(-LRV_DRAWS // 50))], "block int, batch int")
    return jobs.groupBy("block", "batch").applyInPandas(run, "block int, draw long, omega double")


@query("lrv_upper_boot", None)
def lrv_upper_boot(spark, sf):
    """By block: the upper quantile over draws of the largest long-run variance, and the point estimate over lags."""
    x = _losses(spark, sf)
    point = float(np.max([omega(x[None, :], k) for k in LRV_LAGS]))
    return _lrv_draws(spark, x).groupBy("block").agg(F.count("*").alias("draws"), F.percentile("omega", 0.95).alias("upper")).withColumn("point", F.lit(point))


@query("conditional_power", None)
def conditional_power(spark, sf):
    """At the sample size planned for each power target: the share of resampled means, moved by the effect, that exceed
    the critical value. The effect is a share of the mean; the planning variance is the largest bound, times a reserve."""
    import pandas as pd

    x = _losses(spark, sf)
    z = x / x.mean() - 1
    bounds = _lrv_draws(spark, x / x.mean()).groupBy("block").agg(F.percentile("omega", 0.95).alias("upper")).agg(F.max("upper")).head()[0]
    planned = LRV_RESERVE * max(bounds, *(float(omega(z[None, :], k)[0]) for k in LRV_LAGS))
    shared, n_draws = spark.sparkContext.broadcast(z), POWER_DRAWS

    def run(pdf):
        z, target, block, batch, n = shared.value, *pdf.iloc[0][["target", "block", "batch", "n"]]
        n, block, batch = int(n), int(block), int(batch)
        paths = batch * 500 + np.arange(min(500, n_draws - batch * 500))
        around = np.cumsum(np.concatenate([[0.0], np.tile(z, 2)]))
        sums = lambda width, at: around[at + width] - around[at]
        whole, rest = divmod(n, block)
        starts = SIM.hashed((13, int(target * 100), block), paths, whole + 1, len(z))
        total = sums(block, starts[:, :whole]).sum(1) + (sums(rest, starts[:, whole]) if rest else 0)
        hits = total / n + PLANNED_EFFECT > SIM.LEAST_CRITICAL * np.sqrt(planned / n)
        return pd.DataFrame({"target": [target], "block": [block], "n": [n], "hits": [int(hits.sum())], "paths": [len(paths)]})

    size = {t: math.ceil((SIM.LEAST_CRITICAL + NORMAL.inv_cdf(t)) ** 2 * planned / PLANNED_EFFECT**2) for t in POWER_TARGETS}
    jobs = spark.createDataFrame([(t, b, k, size[t]) for t in POWER_TARGETS for b in FULL.blocks for k in range(-(-n_draws // 500))], "target double, block int, batch int, n long")
    out = jobs.groupBy("target", "block", "batch").applyInPandas(run, "target double, block int, n long, hits long, paths long")
    g = out.groupBy("target", "block", "n").agg(F.sum("paths").alias("draws"), (F.sum("hits") / F.sum("paths")).alias("power"))
    return g.withColumns({"mc_se": F.sqrt(F.col("power") * (1 - F.col("power")) / F.col("draws")), "omega": F.lit(float(planned))})
