"""Log-linear variance forecasts: frozen and expanding fits, smearing, evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Regressors of the four models.
MODELS = {"baseline": ("lag_l", "lag_d"), "enhanced": ("lag_l", "lag_d", "log_a"), "har_baseline": ("lag_l", "lag_d", "log_mean5", "log_mean20"), "har_enhanced": ("lag_l", "lag_d", "log_mean5", "log_mean20", "log_a")}
FLOOR = 1e-12


def ledger(daily: DataFrame) -> DataFrame:
    """(date, actual, log_l, log_a, lag_l, lag_d, log_mean5, log_mean20, eligible): eligibility never looks at the label."""
    from .rolling import causal_lag

    d = causal_lag(daily, "l").withColumnsRenamed({"lag_value": "prev_l", "lag_date": "prev_l_date"})
    d = causal_lag(d, "d").withColumnsRenamed({"lag_value": "prev_d", "lag_date": "prev_d_date"})
    order = Window.orderBy("date")
    # Means of the last n known values strictly before, without an age limit.
    known = daily.where("l IS NOT NULL")
    upto = {n: Window.orderBy("date").rowsBetween(1 - n, 0) for n in (5, 20)}
    means = known.select("date", *[F.when(F.count("l").over(w) >= n, F.avg("l").over(w)).alias(f"m{n}") for n, w in upto.items()])
    joined = d.join(means, "date", "left")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    mean = F.last(F.when(F.col("m5").isNotNull() | F.col("m20").isNotNull(), F.struct("m5", "m20")), ignorenulls=True).over(before)
    out = joined.withColumn("_m", mean).select(
        "date", F.col("l").alias("actual"), F.log("l").alias("log_l"), F.log("a").alias("log_a"), F.log("prev_l").alias("lag_l"), F.log("prev_d").alias("lag_d"),
        F.log(F.col("_m")["m5"]).alias("log_mean5"), F.log(F.col("_m")["m20"]).alias("log_mean20"))
    need = [F.col(c).isNotNull() for c in ("log_a", "lag_l", "lag_d", "log_mean5", "log_mean20")]
    eligible = need[0]
    for c in need[1:]:
        eligible = eligible & c
    return out.withColumn("eligible", eligible)


def forecasts(ledger: DataFrame, train_until, min_train: int = 400, models: dict = MODELS, series: str | None = None) -> DataFrame:
    """(series, date, model, mode, actual, forecast): expanding refits up to train_until, frozen coefficients after it.

    series names the column that keeps series apart; without it the ledger is one. A series is a group of a few thousand
    rows. Its refits come from running cross-products; the mean of exponential residuals has no running sum.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["_series"].iloc[0]
        pdf = pdf[pdf.eligible].sort_values("date").reset_index(drop=True)
        y, known = pdf.log_l.to_numpy(float), pdf.log_l.notna().to_numpy()
        early = (pdf.date <= train_until).to_numpy()
        out = []
        for name, cols in models.items():
            x = np.column_stack([np.ones(len(pdf)), *[pdf[c].to_numpy(float) for c in cols]])

            xk, yk = x[known], y[known]
            gram = np.cumsum(xk[:, :, None] * xk[:, None, :], axis=0)
            cross = np.cumsum(xk * yk[:, None], axis=0)

            def value(at: np.ndarray, m: int) -> np.ndarray:
                """Forecasts of these rows from the first m known ones."""
                b = np.linalg.solve(gram[m - 1], cross[m - 1])
                return np.maximum(FLOOR, np.exp(x[at] @ b) * np.exp(yk[:m] - xk[:m] @ b).mean())

            before = np.cumsum(known) - known
            for t in np.flatnonzero(early & (before >= min_train)):
                out.append((pdf.date[t], name, "expanding", pdf.actual[t], float(value(np.array([t]), before[t])[0])))
            m = int((known & early).sum())
            if m >= min_train and (~early).any():
                late = np.flatnonzero(~early)
                out += [(pdf.date[t], name, "frozen", pdf.actual[t], float(v)) for t, v in zip(late, value(late, m))]
        return pd.DataFrame(out, columns=["date", "model", "mode", "actual", "forecast"]).assign(series=key)[["series", "date", "model", "mode", "actual", "forecast"]]

    kind = ledger.schema[series].dataType.simpleString() if series else "int"
    one = ledger.withColumn("_series", F.col(series) if series else F.lit(0))
    out = one.groupBy("_series").applyInPandas(run, f"series {kind}, date date, model string, mode string, actual double, forecast double")
    return out if series else out.drop("series")
