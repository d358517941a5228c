"""Sizing and performance of books of trades (book, n, exit_date, r, risk, direction, minutes).

``by`` names the columns that keep books apart; without them all trades are one book.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rolling import DRAWN, braked, equity, ordered, runs
from .simulate import hashed

START = 100_000.0
YEAR = 252


def sized(trades: DataFrame, base: float = 0.01, by: tuple[str, ...] = ()) -> DataFrame:
    """trades with fraction, equity before each trade, profit and ounces; the brake depends on R alone."""
    e = equity(trades.withColumn("fraction", braked(base, by=by)), F.col("fraction"), by=by)
    before = F.coalesce(F.lag("equity").over(ordered("n", by)), F.lit(1.0)) * START
    return e.withColumn("before", before).withColumns({"profit": F.col("before") * F.col("fraction") * F.col("r"), "ounces": F.col("before") * F.col("fraction") / F.col("risk")})


def daily_returns(sized_trades: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, date, ret) on every business day from a book's first exit to its last: the sum of fraction * r, 0 without trades."""
    limits = sized_trades.groupBy(*by).agg(F.min("exit_date").alias("a"), F.max("exit_date").alias("b")).where("a IS NOT NULL")
    days = limits.select(*by, F.explode(F.sequence("a", "b")).alias("date")).where(F.weekday("date") < 5)
    sums = sized_trades.groupBy(*by, F.col("exit_date").alias("date")).agg(F.sum(F.col("fraction") * F.col("r")).alias("x"))
    return days.join(sums, [*by, "date"], "left").select(*by, "date", F.coalesce("x", F.lit(0.0)).alias("ret"))


def _joined(frames: list[DataFrame], by: tuple[str, ...]) -> DataFrame:
    """Frames of one row a book, side by side."""
    out = frames[0]
    for f in frames[1:]:
        # Without books each frame is one row.
        out = out.join(f, list(by), "left") if by else out.crossJoin(f)
    return out


def _daily_metrics(days: DataFrame, by: tuple[str, ...]) -> list[DataFrame]:
    """Figures of daily returns; hit rates of calendar months and years; the longest drawdown of daily equity, in days."""
    grouped = days.groupBy(*by)
    down = F.sqrt(F.avg(F.pow(F.least("ret", F.lit(0.0)), 2)))
    year = math.sqrt(YEAR)
    d = grouped.agg(
        (F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0)) * year).alias("sharpe"), (F.avg("ret") / F.nullif(down, F.lit(0.0)) * year).alias("sortino"),
        (F.stddev_samp("ret") * year).alias("volatility"), F.count("*").alias("business_days"))

    def hits(period: str) -> DataFrame:
        each = days.groupBy(*by, F.trunc("date", period).alias("period")).agg(F.sum(F.log1p("ret")).alias("x"))
        return each.groupBy(*by).agg(F.avg((F.col("x") > 1e-12).cast("double")).alias(f"{period}ly_hit_rate"))

    e = equity(days.withColumn("r", F.col("ret")), F.lit(1.0), "date", by)
    below = runs(e, F.col("drawdown") > DRAWN, "date", by).groupBy(*by).agg(F.max("length").alias("drawdown_days"))
    return [d, hits("month"), hits("year"), below]


def metrics(trades: DataFrame, base: float = 0.01, by: tuple[str, ...] = ()) -> DataFrame:
    """One row of performance figures a book; null where a denominator is empty. Moments of R are those of the sample."""
    s = sized(trades, base, by)
    r = F.col("r")
    win, loss = F.sum(F.when(r > 0, r)), -F.sum(F.when(r < 0, r))
    hit = lambda c: F.avg((c > 0).cast("double"))
    t = s.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("r").alias("mean_r"), F.percentile("r", 0.5).alias("median_r"), F.sum("r").alias("total_r"), F.stddev_samp("r").alias("sd_r"),
        F.try_divide(win, loss).alias("profit_factor"), F.try_divide(F.sum(F.when(r > 0, F.col("profit"))), -F.sum(F.when(r < 0, F.col("profit")))).alias("cash_profit_factor"),
        hit(r).alias("hit_rate"), hit(F.when(F.col("direction") == "long", r)).alias("long_hit_rate"), hit(F.when(F.col("direction") == "short", r)).alias("short_hit_rate"),
        F.avg(F.when(r > 0, r)).alias("mean_win"), F.avg(F.when(r < 0, r)).alias("mean_loss"), F.max("r").alias("best"), F.min("r").alias("worst"),
        F.skewness(r).alias("skew_r"), F.kurtosis(r).alias("kurtosis_r"), F.max_by("equity", "n").alias("final"), F.max("drawdown").alias("max_drawdown"), (2 * F.sum("ounces")).alias("turnover"),
        F.datediff(F.max("exit_date"), F.min("exit_date")).alias("days"), (F.sum("minutes") / 60).alias("exposure_hours"))
    streak = runs(s, r < 0, "n", by).groupBy(*by).agg(F.max("length").alias("losing_streak"))
    one = _joined([t, *_daily_metrics(daily_returns(s, by), by), streak], by)
    years = F.greatest(F.col("days"), F.lit(1)) / 365.25
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("losing_streak", "drawdown_days")}
    derived = {"total_return": F.col("final") - 1, "cagr": F.pow("final", 1 / years) - 1, "payoff": F.try_divide(F.col("mean_win"), -F.col("mean_loss")), "exposure_share": F.try_divide(F.col("exposure_hours"), 24 * F.col("business_days"))}
    out = one.withColumns(zero | derived)
    return out.withColumn("mar", F.try_divide(F.col("cagr"), F.col("max_drawdown")))


def _below(text: str, n: Column) -> Column:
    """A whole number under n from a hash of a text with columns in braces."""
    parts = [F.col(p[1:-1]).cast("string") if p.startswith("{") else F.lit(p) for p in text.split("|")]
    return F.pmod(F.xxhash64(F.concat_ws(":", *parts)), n)


def draws(trades: DataFrame, daily: DataFrame, paths: int, horizon: int = YEAR, block: int = 10, seed: int = 20) -> DataFrame:
    """(method, path, t, x): R of resampled years. iid: single trades at evenly spaced days, at the books' mean pace; block:
    runs of days of one book's sums of R, around its end. A draw picks a book, then one of its rows: books weigh alike.

    Draws meet books, trades and days by joins on their numbers; no book reaches the driver.
    """
    numbered = daily.withColumn("day", F.row_number().over(Window.partitionBy("book").orderBy("date")) - 1)
    books = trades.groupBy("book").agg(F.count("*").alias("m")).join(daily.groupBy("book").agg(F.count("*").alias("days")), "book")
    # One row a book goes through the one window without a partition.
    books = books.withColumn("i", F.row_number().over(Window.orderBy("book")) - 1)
    n_books, n_trades, n_days = books.agg(F.count("*"), F.sum("m"), F.sum("days")).head()
    if not n_books:
        return trades.sparkSession.createDataFrame([], "method string, path long, t int, x double")
    pace = max(1, round(n_trades / n_days * horizon))
    at = sorted({int(t) for t in np.linspace(0, horizon - 1, pace)})
    start = trades.sparkSession.range(paths).withColumnRenamed("id", "path")
    single = start.withColumn("t", F.explode(F.array(*map(F.lit, at)))).withColumn("i", _below(f"{seed}|iid|{{path}}|{{t}}", F.lit(n_books)))
    single = single.join(books, "i").withColumn("n", 1 + _below(f"{seed}|trade|{{path}}|{{t}}", F.col("m")))
    single = single.join(trades.select("book", "n", "r"), ["book", "n"]).select(F.lit("iid").alias("method"), "path", "t", F.col("r").alias("x"))
    blocks = start.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(-(-horizon // block) - 1)))).withColumn("i", _below(f"{seed}|block|{{path}}|{{k}}", F.lit(n_books)))
    blocks = blocks.join(books, "i").withColumn("from", _below(f"{seed}|day|{{path}}|{{k}}", F.col("days"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    blocks = blocks.select("book", "path", (F.col("k") * block + F.col("j")).alias("t"), F.pmod(F.col("from") + F.col("j"), F.col("days")).alias("day")).where(F.col("t") < horizon)
    moved = blocks.join(numbered.select("book", "day", "ret"), ["book", "day"]).select(F.lit("block").alias("method"), "path", "t", F.col("ret").alias("x"))
    return single.unionByName(moved)


def losing_runs(x: np.ndarray) -> np.ndarray:
    """Of each row the longest run of trues."""
    at = np.arange(1, x.shape[1] + 1)
    return (at - np.maximum.accumulate(np.where(x, 0, at), axis=1)).max(1)


def resampled_years(x: np.ndarray, base: float, month: int = 21) -> dict[str, np.ndarray]:
    """Figures of years of R (paths by days, 0: no trade) at a base risk, halved by the brake."""
    traded = x != 0
    before = np.cumsum(traded, axis=1) - traded
    # R of trades side by side, and their running sums: the brake looks at a path's last 20 trades before the day.
    row, _ = np.nonzero(traded)
    only = np.zeros((len(x), x.shape[1] + 1))
    only[row, before[traded] + 1] = x[traded]
    sums = np.cumsum(only, axis=1)
    recent = np.take_along_axis(sums, before, 1) - np.take_along_axis(sums, np.maximum(before - 20, 0), 1)
    risk = np.where((before >= 20) & (np.round(recent, 9) < -4), base / 2, base)
    ret = risk * x
    growth = np.cumsum(np.log(np.maximum(1 + ret, 1e-9)), axis=1)
    level = np.exp(growth)
    depth = 1 - level / np.maximum(1, np.maximum.accumulate(level, axis=1))
    spread = ret.std(1, ddof=1)
    months = np.diff(growth[:, month - 1 :: month], axis=1, prepend=0)
    return {
        "max_drawdown": depth.max(1), "terminal": level[:, -1], "lowest": np.minimum(1, level.min(1)), "sharpe": np.where(spread > 0, ret.mean(1) / np.where(spread > 0, spread, 1) * math.sqrt(YEAR), np.nan),
        "drawdown_days": losing_runs(depth > DRAWN), "losing_streak": losing_runs(only[:, 1:] < 0), "losing_months": (months < -1e-12).sum(1),
    }


_PATH = "method string, risk double, path long, max_drawdown double, terminal double, lowest double, sharpe double, drawdown_days long, losing_streak long, losing_months long"


def monte_carlo(trades: DataFrame, daily: DataFrame, paths: int = 10_000, horizon: int = YEAR, risks: tuple[float, ...] = (0.0025, 0.005, 0.0075, 0.01), block: int = 10, batch: int = 500, seed: int = 20) -> DataFrame:
    """Loss risks of resampled years by method and base risk: shares of paths beyond limits, and quantiles over paths.

    daily: (book, date, ret) with ret the sum of R. A batch of paths is one group; it returns one row a path and risk.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        path, at = np.unique(pdf["path"].to_numpy(), return_inverse=True)
        x = np.zeros((len(path), horizon))
        x[at, pdf["t"].to_numpy()] = pdf["x"].to_numpy()
        out = [pd.DataFrame({"method": pdf["method"].iloc[0], "risk": risk, "path": path} | resampled_years(x, risk)) for risk in risks]
        return pd.concat(out)[[c.split()[0] for c in _PATH.split(", ")]]

    rows = draws(trades, daily, paths, horizon, block, seed).groupBy("method", F.floor(F.col("path") / batch).alias("batch")).applyInPandas(run, _PATH)
    share = lambda c, name: F.avg(c.cast("double")).alias(name)
    deep = F.col("max_drawdown")
    known = {c: F.when(~F.isnan(c), F.col(c)) if c == "sharpe" else F.col(c) for c in ("max_drawdown", "terminal", "sharpe", "drawdown_days", "losing_streak", "losing_months")}
    quantiles = [F.percentile(known[c], q).alias(f"{c}_p{int(q * 100):02d}") for c in known for q in (0.05, 0.5, 0.95)]
    return rows.groupBy("method", "risk").agg(
        F.count("*").alias("paths"), share(deep > 0.1, "p_dd10"), share(deep > 0.2, "p_dd20"), share(deep > 0.3, "p_dd30"), share(F.col("terminal") < 1, "p_loss"), share(F.col("lowest") <= 0.5, "p_ruin"),
        F.avg("losing_streak").alias("mean_streak"), F.avg("losing_months").alias("mean_losing_months"), F.avg("terminal").alias("mean_equity"), *quantiles)
