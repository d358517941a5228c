"""Regression, robust inference, bootstrap, forecasts and their evaluation."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import losses as L
from ..functions import stats as ST
from ..operators import forecast as FC
from ..operators import rolling as R
from ..sources.market import daily
from .registry import query
from .rolling import _V, valid
from .views import q6, r6, sql

_LOG = _V + ", x AS (SELECT date, ln(a) AS la, ln(l) AS ll, lag(ln(l)) OVER (ORDER BY date) AS lag_ll, l, lag(l) OVER (ORDER BY date) AS lag_l FROM v), y AS (SELECT * FROM x WHERE lag_ll IS NOT NULL)"


def logs(spark, sf):
    o = R.ordered("date")
    x = valid(spark, sf).select("date", F.log("a").alias("la"), F.log("l").alias("ll"), F.lag(F.log("l")).over(o).alias("lag_ll"), "l", F.lag("l").over(o).alias("lag_l"))
    return x.where("lag_ll IS NOT NULL")


def _omega(lags: int, table: str = "z") -> str:
    """Bartlett long-run variance of column z of a table with t and n."""
    parts = " + ".join(f"2 * (1 - {k} / {lags + 1}.0) * coalesce(sum(z * z{k}), 0)" for k in range(1, lags + 1))
    lagged = ", ".join(f"lag(z, {k}) OVER (ORDER BY t) AS z{k}" for k in range(1, lags + 1))
    return f"(SELECT greatest(0, (sum(z * z) + {parts}) / count(*)) FROM (SELECT z, {lagged} FROM {table}))"


_Z = ", z AS (SELECT date AS t, a - avg(a) OVER () AS z FROM v)"


@query("ols_simple", sql(_LOG, f"SELECT {q6('regr_slope(ll, lag_ll)', 'slope')}, {q6('regr_intercept(ll, lag_ll)', 'intercept')}, {q6('regr_r2(ll, lag_ll)', 'r2')}, count(*) AS n FROM y"))
def ols_simple(spark, sf):
    fit = ST.ols(logs(spark, sf), "ll", ["lag_ll"])
    return spark.createDataFrame([(fit.beta[1].item(), fit.beta[0].item(), float(fit.r2), fit.n)], "slope double, intercept double, r2 double, n long").select(r6("slope", "slope"), r6("intercept", "intercept"), r6("r2", "r2"), "n")


_TWO = _LOG + """, c AS (SELECT ll - avg(ll) OVER () AS y0, lag_ll - avg(lag_ll) OVER () AS x1, la - avg(la) OVER () AS x2 FROM y),
s AS (SELECT sum(x1*x1) AS s11, sum(x1*x2) AS s12, sum(x2*x2) AS s22, sum(x1*y0) AS s1y, sum(x2*y0) AS s2y, sum(y0*y0) AS syy FROM c),
b AS (SELECT (s1y*s22 - s2y*s12) / (s11*s22 - s12*s12) AS b1, (s2y*s11 - s1y*s12) / (s11*s22 - s12*s12) AS b2, * FROM s)"""


@query("ols_fit", sql(_TWO, f"SELECT {q6('b1', 'b_lag')}, {q6('b2', 'b_asia')}, {q6('(SELECT avg(ll) - b1 * avg(lag_ll) - b2 * avg(la) FROM y)', 'intercept')}, {q6('(b1*s1y + b2*s2y) / syy', 'r2')} FROM b"))
def ols_fit(spark, sf):
    fit = ST.ols(logs(spark, sf), "ll", ["lag_ll", "la"])
    return spark.createDataFrame([(*[float(x) for x in (fit.beta[1], fit.beta[2], fit.beta[0])], float(fit.r2))], "b_lag double, b_asia double, intercept double, r2 double").select(*[r6(c, c) for c in ("b_lag", "b_asia", "intercept", "r2")])


@query("hac_cov", sql(_LOG, f""", f AS (SELECT regr_slope(ll, lag_ll) AS b, regr_intercept(ll, lag_ll) AS a, avg(lag_ll) AS m, sum(power(lag_ll, 2)) - count(*) * power(avg(lag_ll), 2) AS sxx FROM y),
z AS (SELECT date AS t, (ll - a - b * lag_ll) * (lag_ll - m) AS z FROM y, f) SELECT {q6('b', 'slope')}, {q6('sqrt((SELECT count(*) FROM y) * ' + _omega(5) + ') / sxx', 'se')} FROM f"""))
def hac_cov(spark, sf):
    fit = ST.ols(logs(spark, sf), "ll", ["lag_ll"], "date", 5)
    return spark.createDataFrame([(float(fit.beta[1]), float(fit.se()[1]))], "slope double, se double").select(r6("slope", "slope"), r6("se", "se"))


@query("hac_mean", sql(_V + _Z, f"SELECT {q6('m', 'mean')}, {q6('sqrt(o / n)', 'se')}, {q6('m / sqrt(o / n)', 't')} FROM (SELECT avg(a) AS m, count(*) AS n, {_omega(5)} AS o FROM v)"))
def hac_mean(spark, sf):
    v = valid(spark, sf)
    one = v.agg(F.avg("a").alias("m"), F.count("a").alias("n")).crossJoin(F.broadcast(ST.bartlett_lrv(v, "a", "date", 5)))  # one row each
    se = F.sqrt(F.col("omega") / F.col("n"))
    return one.select(r6("m", "mean"), r6(se, "se"), r6(F.col("m") / se, "t"))


@query("t_p_ci_r2", None)
def t_p_ci_r2(spark, sf):
    fit = ST.ols(logs(spark, sf), "ll", ["lag_ll", "la"], "date", 5)
    out = spark.createDataFrame(fit.rows(), "term string, beta double, se double, t double, p double, ci_low double, ci_high double")
    return out.withColumns({"r2": F.lit(float(fit.r2)), "n": F.lit(fit.n)})


@query("bh_fdr", "SELECT test, round(p, 6) + 0.0 AS p, round(least(1.0, min(p * 7 / rk) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) + 0.0 AS q FROM (SELECT test, p::DOUBLE AS p, row_number() OVER (ORDER BY p) AS rk FROM (VALUES ('a', 0.001), ('b', 0.012), ('c', 0.03), ('d', 0.04), ('e', 0.2), ('f', 0.5), ('g', 0.9)) x(test, p))")
def bh_fdr(spark, sf):
    t = spark.createDataFrame(list(zip("abcdefg", (0.001, 0.012, 0.03, 0.04, 0.2, 0.5, 0.9))), "test string, p double")
    return ST.benjamini_hochberg(t).select("test", r6("p", "p"), r6("q", "q"))


_DRAWS = ", draws AS (SELECT draw, k, CAST('0x' || substr(md5('1:' || draw || ':' || k), 1, 8) AS BIGINT) % n AS start, n FROM range(0, 2000) d(draw), (SELECT count(*) AS n FROM v), range(0, 1000) kk(k) WHERE k < ceil(n / 10.0))"
_NUM = ", num AS (SELECT row_number() OVER (ORDER BY date) - 1 AS t, a, count(*) OVER () AS n FROM v)"
_BOOT = _V + _DRAWS + _NUM + ", boot AS (SELECT d.draw, avg(m.a) AS mean FROM draws d JOIN range(0, 10) j(j) ON d.k * 10 + j.j < d.n JOIN num m ON m.t = (d.start + j.j) % d.n GROUP BY 1)"


#: Resamples of means and coefficients, of paired differences, and of shifts; valid resamples needed.
DRAWS, PAIRED_DRAWS, SHIFTS, VALID_SHARE = 2000, 10_000, 2000, 0.99


def _boot(spark, sf, block: int = 10):
    s = ST.drawn_sums(valid(spark, sf).select("date", "a", F.lit(1.0).alias("c")), ["a", "c"], "date", block, DRAWS)
    return s.select("draw", (F.col("a") / F.col("c")).alias("mean"))


@query("block_boot_mean", sql(_BOOT, f"SELECT draw, {q6('mean', 'mean')} FROM boot"))
def block_boot_mean(spark, sf):
    return _boot(spark, sf).select("draw", r6("mean", "mean"))


_PAIRED = _V + """, num AS (SELECT row_number() OVER (ORDER BY date) - 1 AS t, CASE WHEN d IS NOT NULL THEN a - l END AS x, count(*) OVER () AS n FROM daily),
draws AS (SELECT draw, k, CAST('0x' || substr(md5('1:' || draw || ':' || k), 1, 8) AS BIGINT) % n AS start, n FROM range(0, 10000) d(draw), (SELECT max(n) AS n FROM num), range(0, 1000) kk(k) WHERE k < ceil(n / 10.0)),
boot AS (SELECT d.draw, avg(m.x) AS mean FROM draws d JOIN range(0, 10) j(j) ON d.k * 10 + j.j < d.n JOIN num m ON m.t = (d.start + j.j) % d.n GROUP BY 1)"""


@query("paired_block_ci", sql(_PAIRED, f"SELECT count(mean) AS draws, {q6('quantile_cont(mean, 0.025)', 'ci_low')}, {q6('quantile_cont(mean, 0.975)', 'ci_high')} FROM boot"))
def paired_block_ci(spark, sf):
    """Differences keep their calendar positions, unknown ones included; resamples without any known day don't count, and
    too few that count are an error."""
    x = daily(spark, sf).select("date", F.when(F.col("d").isNotNull(), F.col("a") - F.col("l")).alias("x"))
    s = ST.drawn_sums(x.withColumn("c", F.col("x").isNotNull().cast("double")), ["x", "c"], "date", 10, PAIRED_DRAWS)
    g = s.select(F.try_divide("x", "c").alias("mean")).agg(F.count("mean").alias("draws"), F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))
    enough = F.col("draws") >= VALID_SHARE * PAIRED_DRAWS
    bound = lambda k: F.when(enough, F.col("ci")[k]).otherwise(F.raise_error(F.lit("too few resamples hold a known day")).cast("double"))
    return g.select("draws", r6(bound(0), "ci_low"), r6(bound(1), "ci_high"))


@query("boot_count_matrix", sql(_BOOT, f"SELECT {q6('avg(mean)', 'mean')}, {q6('stddev_samp(mean)', 'se')} FROM boot"))
def boot_count_matrix(spark, sf):
    return _boot(spark, sf).agg(r6(F.avg("mean"), "mean"), r6(F.stddev_samp("mean"), "se"))


_BETA = _LOG + """, num AS (SELECT row_number() OVER (ORDER BY date) - 1 AS t, ll AS y, lag_ll AS u, la AS w, count(*) OVER () AS n FROM y),
draws AS (SELECT draw, k, CAST('0x' || substr(md5('1:' || draw || ':' || k), 1, 8) AS BIGINT) % n AS start, n FROM range(0, 2000) d(draw), (SELECT max(n) AS n FROM num), range(0, 1000) kk(k) WHERE k < ceil(n / 5.0)),
sums AS (SELECT d.draw, count(*) AS c, sum(u * u) - sum(u) * sum(u) / count(*) AS uu, sum(w * w) - sum(w) * sum(w) / count(*) AS ww, sum(u * w) - sum(u) * sum(w) / count(*) AS uw, sum(u * y) - sum(u) * sum(y) / count(*) AS uy, sum(w * y) - sum(w) * sum(y) / count(*) AS wy
  FROM draws d JOIN range(0, 5) j(j) ON d.k * 5 + j.j < d.n JOIN num m ON m.t = (d.start + j.j) % d.n GROUP BY 1),
boot AS (SELECT (ww * uy - uw * wy) / (uu * ww - uw * uw) AS beta FROM sums)"""


@query("block_boot_beta", sql(_BETA, f"SELECT count(beta) AS draws, {q6('quantile_cont(beta, 0.025)', 'ci_low')}, {q6('quantile_cont(beta, 0.975)', 'ci_high')} FROM boot"))
def block_boot_beta(spark, sf):
    b = ST.bootstrap_coefficients(logs(spark, sf), "ll", ["lag_ll", "la"], "lag_ll", "date", draws=DRAWS)
    return b.agg(F.count("beta").alias("draws"), r6(F.percentile("beta", 0.025), "ci_low"), r6(F.percentile("beta", 0.975), "ci_high"))


@query("assoc_simple", sql(_LOG, f"SELECT year(date)::INTEGER AS year, count(*) AS n, {q6('regr_slope(ll, la)', 'slope')}, {q6('regr_r2(ll, la)', 'r2')} FROM y GROUP BY 1 HAVING count(*) > 20"))
def assoc_simple(spark, sf):
    g = logs(spark, sf).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n"), r6(F.regr_slope("ll", "la"), "slope"), r6(F.regr_r2("ll", "la"), "r2"))
    return g.where("n > 20")


@query("se_circular", sql(_V + _NUM + """, e AS (SELECT t, a, n FROM num UNION ALL SELECT t + n, a, n FROM num WHERE t < 9),
s AS (SELECT t, n, sum(a) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS s10, sum(a) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND greatest(0, (SELECT count(*) % 10 FROM v) - 1) FOLLOWING) AS sr FROM e)""", f"SELECT {q6('sqrt((max(n) // 10) * var_pop(s10) + CASE WHEN max(n) % 10 > 0 THEN var_pop(sr) ELSE 0 END) / max(n)', 'se')} FROM s WHERE t < n"))
def se_circular(spark, sf):
    v = valid(spark, sf)
    n = v.count()
    rest = n % 10
    whole = R.circular_block_sums(v, "a", 10, "date").agg(F.var_pop("s").alias("whole"))
    last = R.circular_block_sums(v, "a", rest, "date").agg(F.var_pop("s").alias("last")) if rest else spark.createDataFrame([(0.0,)], "last double")
    # One row each.
    return whole.crossJoin(last).select(r6(F.sqrt(F.lit(n // 10) * F.col("whole") + F.col("last")) / n, "se"))


_SHIFT = _V + """, k AS (SELECT row_number() OVER (ORDER BY date) - 1 AS t, rank() OVER (ORDER BY a) AS ra, rank() OVER (ORDER BY l) AS rl, count(*) OVER () AS n FROM v),
sh AS (SELECT s, (10 + CAST('0x' || substr(md5('shift:' || s), 1, 8) AS BIGINT) % greatest(n - 20, 1)) % n AS sh FROM range(0, 2000) r(s), (SELECT count(*) AS n FROM v)),
p AS (SELECT s, corr(x.ra, y.rl) AS rho FROM sh JOIN k x ON true JOIN k y ON y.t = (x.t + sh.sh) % x.n GROUP BY 1)"""


@query("circ_shift_perm", sql(_SHIFT, f"SELECT (SELECT count(*) FROM p) AS shifts, {q6('o.rho', 'rho')}, {q6('(1 + (SELECT count(*) FROM p WHERE round(abs(p.rho), 9) >= round(abs(o.rho), 9))) / 2001.0::DOUBLE', 'p')} FROM (SELECT corr(ra, rl) AS rho FROM k) o"))
def circ_shift_perm(spark, sf):
    """Rank correlation, and the share of series shifted around their end (by 10 days at least) that reach it."""
    from ..functions.moments import average_rank

    v = average_rank(average_rank(valid(spark, sf), "a", "ra"), "l", "rl")
    k = v.select((F.row_number().over(R.ordered("date")) - 1).alias("t"), "ra", "rl")
    n, rho = k.agg(F.count("*"), F.corr("ra", "rl")).head()
    shift = (10 + F.conv(F.substring(F.md5(F.concat(F.lit("shift:"), F.col("shift_id").cast("string"))), 1, 8), 16, 10).cast("long") % max(n - 20, 1)) % max(n, 1)
    # Every row meets one partner for each of a fixed number of shifts.
    moved = k.select("t", "ra", F.explode(F.sequence(F.lit(0), F.lit(SHIFTS - 1))).alias("shift_id")).withColumn("u", (F.col("t") + shift) % max(n, 1))
    each = moved.join(k.select(F.col("t").alias("u"), "rl"), "u").groupBy("shift_id").agg(F.corr("ra", "rl").alias("rho"))
    reached = F.round(F.abs("rho"), 9) >= F.round(F.abs(F.lit(rho).cast("double")), 9)
    return each.agg(F.count("*").alias("shifts"), r6(F.lit(rho).cast("double"), "rho"), r6((1 + F.count_if(reached)) / F.lit(SHIFTS + 1.0), "p"))


@query("extreme_directed", sql(_V + ", z AS (SELECT (a - avg(a) OVER ()) / stddev_samp(a) OVER () AS z, l - avg(l) OVER () AS y FROM v)", f"SELECT count(*) AS n, {q6('avg(sign(z) * y)', 'mean_directed')}, {q6('avg((sign(z) * y > 0)::INTEGER)', 'hit_rate')} FROM z WHERE abs(z) >= 1.5"))
def extreme_directed(spark, sf):
    w = Window.partitionBy()
    z = valid(spark, sf).select(((F.col("a") - F.avg("a").over(w)) / F.stddev_samp("a").over(w)).alias("z"), (F.col("l") - F.avg("l").over(w)).alias("y")).where(F.abs("z") >= 1.5)
    s = F.signum("z") * F.col("y")
    return z.agg(F.count("*").alias("n"), r6(F.avg(s), "mean_directed"), r6(F.avg((s > 0).cast("int")), "hit_rate"))


@query("lrv_bartlett", sql(_V + _Z, f"SELECT 5 AS lags, {q6(_omega(5), 'omega')} UNION ALL SELECT 10, {q6(_omega(10), 'omega')} UNION ALL SELECT 20, {q6(_omega(20), 'omega')}"))
def lrv_bartlett(spark, sf):
    v = valid(spark, sf)
    parts = [ST.bartlett_lrv(v, "a", "date", k).select(F.lit(k).alias("lags"), r6("omega", "omega")) for k in (5, 10, 20)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("lrv_block", sql(_V + _NUM + ", e AS (SELECT t, a, n FROM num UNION ALL SELECT t + n, a, n FROM num WHERE t < 9), s AS (SELECT t, n, sum(a) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS s FROM e)", f"SELECT {q6('var_pop(s) / 10', 'omega')} FROM s WHERE t < n"))
def lrv_block(spark, sf):
    return R.circular_block_sums(valid(spark, sf), "a", 10, "date").agg(r6(F.var_pop("s") / 10, "omega"))


@query("required_n", "SELECT d AS effect, p AS power, ceil(power(1.959963984540054 + CASE p WHEN 0.8 THEN 0.8416212335729143 ELSE 1.2815515655446004 END, 2) * 7.6139 / power(d, 2))::BIGINT AS n FROM (VALUES (0.03::DOUBLE), (0.05), (0.1)) x(d), (VALUES (0.8::DOUBLE), (0.9)) y(p)")
def required_n(spark, sf):
    cells = [(d, p, ST.NORMAL.inv_cdf(p)) for d in (0.03, 0.05, 0.1) for p in (0.8, 0.9)]
    g = spark.createDataFrame(cells, "effect double, power double, z double")
    return g.select("effect", "power", F.ceil(F.pow(F.lit(ST.NORMAL.inv_cdf(0.975)) + F.col("z"), 2) * 7.6139 / F.pow("effect", 2)).cast("long").alias("n"))


_FIT = _LOG + ", f AS (SELECT regr_slope(ll, lag_ll) AS b, regr_intercept(ll, lag_ll) AS a FROM y WHERE date <= DATE '1998-12-31'), p AS (SELECT y.*, a + b * lag_ll AS fit FROM y, f), sm AS (SELECT avg(exp(ll - fit)) AS smear FROM p WHERE date <= DATE '1998-12-31'), fc AS (SELECT date, l, lag_l, greatest(1e-12, exp(fit) * smear) AS forecast FROM p, sm WHERE date > DATE '1998-12-31')"
_END = datetime.date(1998, 12, 31)


def frozen(spark, sf):
    """(date, l, lag_l, forecast) after the training end, from coefficients fit up to it."""
    x = logs(spark, sf)
    train = x.where(F.col("date") <= F.lit(_END))
    fit = ST.ols(train, "ll", ["lag_ll"])
    line = float(fit.beta[0]) + float(fit.beta[1]) * F.col("lag_ll")
    smear = train.agg(F.avg(F.exp(F.col("ll") - line))).head()[0]
    return x.where(F.col("date") > F.lit(_END)).select("date", "l", "lag_l", F.greatest(F.lit(FC.FLOOR), F.exp(line) * smear).alias("forecast"))


@query("log_smearing", sql(_FIT, f"SELECT {q6('smear', 'smear')} FROM sm"))
def log_smearing(spark, sf):
    train = logs(spark, sf).where(F.col("date") <= F.lit(_END))
    fit = ST.ols(train, "ll", ["lag_ll"])
    return train.agg(r6(F.avg(F.exp(F.col("ll") - float(fit.beta[0]) - float(fit.beta[1]) * F.col("lag_ll"))), "smear"))


@query("frozen_fit", sql(_FIT, f"SELECT date, {q6('forecast', 'forecast')} FROM fc"))
def frozen_fit(spark, sf):
    return frozen(spark, sf).select("date", r6("forecast", "forecast"))


@query("predict_var", sql(_LOG, f"SELECT date, {q6('greatest(1e-12, exp(0.5 + 0.25 * lag_ll) * 1.1)', 'forecast')} FROM y"))
def predict_var(spark, sf):
    return logs(spark, sf).select("date", r6(F.greatest(F.lit(FC.FLOOR), F.exp(0.5 + 0.25 * F.col("lag_ll")) * 1.1), "forecast"))


@query("expanding_fit", sql(_LOG, f"SELECT date, {q6('regr_slope(ll, lag_ll) OVER w', 'slope')}, {q6('regr_intercept(ll, lag_ll) OVER w', 'intercept')} FROM y WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) QUALIFY count(*) OVER w >= 400"))
def expanding_fit(spark, sf):
    # Running sums: every refit costs one row, not a pass.
    w = R.ordered("date").rowsBetween(Window.unboundedPreceding, -1)
    x, y = F.col("lag_ll"), F.col("ll")
    s = logs(spark, sf).select("date", F.count("*").over(w).alias("n"), F.sum(x).over(w).alias("x"), F.sum(y).over(w).alias("y"), F.sum(x * x).over(w).alias("xx"), F.sum(x * y).over(w).alias("xy")).where("n >= 400")
    slope = (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / (F.col("n") * F.col("xx") - F.col("x") * F.col("x"))
    return s.select("date", r6(slope, "slope"), r6((F.col("y") - slope * F.col("x")) / F.col("n"), "intercept"))


@query("expanding_smearing", sql(_LOG, f", f AS (SELECT date, regr_slope(ll, lag_ll) OVER w AS b, regr_intercept(ll, lag_ll) OVER w AS a, lag_ll AS x FROM y WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) QUALIFY count(*) OVER w >= 400 AND date <= DATE '1999-06-30') SELECT f.date, {q6('greatest(1e-12, min(exp(a + b * f.x)) * avg(exp(y.ll - a - b * y.lag_ll)))', 'forecast')} FROM f JOIN y ON y.date < f.date GROUP BY f.date".replace(", f AS", " , f AS", 1)))
def expanding_smearing(spark, sf):
    x = logs(spark, sf).select("date", F.col("l").alias("actual"), F.col("ll").alias("log_l"), "lag_ll", F.lit(True).alias("eligible"))
    out = FC.forecasts(x, datetime.date(1999, 6, 30), 400, {"lag": ("lag_ll",)})
    return out.where("mode = 'expanding'").select("date", r6("forecast", "forecast"))


@query("forecast_models", None)
def forecast_models(spark, sf):
    return FC.forecasts(FC.ledger(daily(spark, sf)), datetime.date(1999, 12, 31), 300)


_LOSS = {"mse": ("power(l - forecast, 2)", "power(l - lag_l, 2)"), "mae": ("abs(l - forecast)", "abs(l - lag_l)"), "qlike": ("l / forecast - ln(l / forecast) - 1", "l / lag_l - ln(l / lag_l) - 1")}


@query("loss_mse_mae_qlike", sql(_FIT, "SELECT " + ", ".join(f"{q6(f'avg({e})', k)}" for k, (e, _) in _LOSS.items()) + " FROM fc"))
def loss_mse_mae_qlike(spark, sf):
    return frozen(spark, sf).agg(*[r6(F.avg(f(F.col("l"), F.col("forecast"))), k) for k, f in L.LOSSES.items()])


@query("improvement_fraction", sql(_FIT, " UNION ALL ".join(f"SELECT '{k}' AS loss, {q6(f'(avg({b}) - avg({e})) / avg({b})', 'improvement')} FROM fc" for k, (e, b) in _LOSS.items())))
def improvement_fraction(spark, sf):
    one = frozen(spark, sf).agg(*[L.improvement(F.avg(f(F.col("l"), F.col("lag_l"))), F.avg(f(F.col("l"), F.col("forecast")))).alias(k) for k, f in L.LOSSES.items()])
    return one.select(F.explode(F.create_map(*[x for k in L.LOSSES for x in (F.lit(k), F.col(k))])).alias("loss", "v")).select("loss", r6("v", "improvement"))


_CW = _FIT + ", cw AS (SELECT date, power(ln(l) - ln(lag_l), 2) - power(ln(l) - ln(forecast), 2) + power(ln(lag_l) - ln(forecast), 2) AS g FROM fc), z AS (SELECT date AS t, g - avg(g) OVER () AS z FROM cw)"


@query("clark_west", sql(_CW, f"SELECT {q6('m', 'mean')}, {q6('m / sqrt(o / n)', 't')} FROM (SELECT avg(g) AS m, count(*) AS n, {_omega(5)} AS o FROM cw)"))
def clark_west(spark, sf):
    g = frozen(spark, sf).select("date", L.clark_west(F.col("l"), F.col("lag_l"), F.col("forecast")).alias("g"))
    one = g.agg(F.avg("g").alias("m"), F.count("*").alias("n")).crossJoin(F.broadcast(ST.bartlett_lrv(g, "g", "date", 5)))  # one row each
    return one.select(r6("m", "mean"), r6(F.col("m") / F.sqrt(F.col("omega") / F.col("n")), "t"))


@query("log_mspe", sql(_FIT, f"SELECT {q6('avg(power(ln(l) - ln(forecast), 2))', 'forecast')}, {q6('avg(power(ln(l) - ln(lag_l), 2))', 'base')} FROM fc"))
def log_mspe(spark, sf):
    return frozen(spark, sf).agg(r6(F.avg(F.pow(F.log("l") - F.log("forecast"), 2)), "forecast"), r6(F.avg(F.pow(F.log("l") - F.log("lag_l"), 2)), "base"))


@query("annual_improvement", sql(_FIT, f"SELECT year(date)::INTEGER AS year, count(*) AS n, {q6('(avg(l / lag_l - ln(l / lag_l) - 1) - avg(l / forecast - ln(l / forecast) - 1)) / avg(l / lag_l - ln(l / lag_l) - 1)', 'improvement')} FROM fc GROUP BY 1"))
def annual_improvement(spark, sf):
    b, e = L.qlike(F.col("l"), F.col("lag_l")), L.qlike(F.col("l"), F.col("forecast"))
    return frozen(spark, sf).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n"), r6(L.improvement(F.avg(b), F.avg(e)), "improvement"))


@query("gates", sql(_FIT, ", g AS (SELECT count(*) AS n, (avg(l / lag_l - ln(l / lag_l) - 1) - avg(l / forecast - ln(l / forecast) - 1)) / avg(l / lag_l - ln(l / lag_l) - 1) AS q, (avg(power(l - lag_l, 2)) - avg(power(l - forecast, 2))) / avg(power(l - lag_l, 2)) AS m FROM fc) SELECT 'enough' AS gate, n >= 200 AS pass FROM g UNION ALL SELECT 'qlike', q >= 0.03 FROM g UNION ALL SELECT 'mse', m >= -0.05 FROM g UNION ALL SELECT 'all', n >= 200 AND q >= 0.03 AND m >= -0.05 FROM g".replace(", g AS", " , g AS", 1)))
def gates(spark, sf):
    f = frozen(spark, sf)
    imp = lambda k: L.improvement(F.avg(L.LOSSES[k](F.col("l"), F.col("lag_l"))), F.avg(L.LOSSES[k](F.col("l"), F.col("forecast"))))
    one = f.agg((F.count("*") >= 200).alias("enough"), (imp("qlike") >= 0.03).alias("qlike"), (imp("mse") >= -0.05).alias("mse"))
    one = one.withColumn("all", F.col("enough") & F.col("qlike") & F.col("mse"))
    return one.select(F.explode(F.create_map(*[x for k in one.columns for x in (F.lit(k), F.col(k))])).alias("gate", "pass"))


@query("wilson_ci", f"SELECT k::BIGINT AS k, n::BIGINT AS n, {q6('(k/n + 3.8414588206941254/(2*n) - 1.959963984540054*sqrt(k/n*(1-k/n)/n + 3.8414588206941254/(4*n*n))) / (1 + 3.8414588206941254/n)', 'low')}, {q6('(k/n + 3.8414588206941254/(2*n) + 1.959963984540054*sqrt(k/n*(1-k/n)/n + 3.8414588206941254/(4*n*n))) / (1 + 3.8414588206941254/n)', 'high')} FROM (VALUES (28::DOUBLE, 2000::DOUBLE), (947, 1000), (0, 50), (50, 50)) x(k, n)")
def wilson_ci(spark, sf):
    z = ST.NORMAL.inv_cdf(0.975)
    t = spark.createDataFrame([(28.0, 2000.0), (947.0, 1000.0), (0.0, 50.0), (50.0, 50.0)], "k double, n double")
    return t.select(F.col("k").cast("long").alias("k"), F.col("n").cast("long").alias("n"), r6(ST.wilson(F.col("k"), F.col("n"), z, False), "low"), r6(ST.wilson(F.col("k"), F.col("n"), z, True), "high"))


@query("critical_value", sql(_V, f"SELECT {q6('max(greatest(1.96, c))', 'critical')} FROM (SELECT list_sort(list(a))[ceil(0.975 * (count(*) - 1))::BIGINT + 1] AS c FROM v GROUP BY year(date))"))
def critical_value(spark, sf):
    # The smallest value whose rank is not below the quantile, of each block; then the largest.
    w = Window.partitionBy("year")
    v = valid(spark, sf).select(F.year("date").alias("year"), "a")
    k = v.withColumns({"i": F.row_number().over(w.orderBy("a")) - 1, "n": F.count("*").over(w)})
    return k.where(F.col("i") == F.ceil(0.975 * (F.col("n") - 1))).agg(r6(F.max(F.greatest(F.lit(1.96), F.col("a"))), "critical"))


@query("effect_interp", f"SELECT {q6('x0 + (0.05 - y0) / (y1 - y0) * (x1 - x0)', 'multiplier')} FROM (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM (VALUES (0.0::DOUBLE, 0.0::DOUBLE), (0.25, 0.011), (0.5, 0.029), (0.75, 0.061), (1.0, 0.12)) t(x, y)) WHERE y0 < 0.05 AND y1 >= 0.05 ORDER BY x0 LIMIT 1")
def effect_interp(spark, sf):
    g = spark.createDataFrame([(0.0, 0.0), (0.25, 0.011), (0.5, 0.029), (0.75, 0.061), (1.0, 0.12)], "x double, y double")
    o = Window.orderBy("x")
    e = g.select("x", "y", F.lead("x").over(o).alias("x1"), F.lead("y").over(o).alias("y1")).where("y < 0.05 AND y1 >= 0.05")
    first = e.agg(F.min_by(F.struct("x", "y", "x1", "y1"), "x").alias("s")).select("s.*")
    return first.select(r6(F.col("x") + (0.05 - F.col("y")) / (F.col("y1") - F.col("y")) * (F.col("x1") - F.col("x")), "multiplier"))
