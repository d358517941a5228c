"""Association of two series at every circular shift of one of them, in n log n.

All n products of a series with its shifted partner are one circular cross-correlation: a transform of both, a product, a
transform back. The transform itself is dealt out: an index is cut in two (low and high part of about the same size), a
first pass transforms along the high part for each low part, a second along the low part. Each pass is a grouping, so no
task holds a series: a group has the square root of the padded length. The middle passes, forth and back, share a grouping.

Series are kept apart by a column; theirs and the numbers of their rows are all that is needed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import attached, numbered
from ..sources.files import temporary


def _turn(numbers: np.ndarray, m: int) -> np.ndarray:
    return np.exp(-2j * np.pi * (numbers % m) / m)


def circular_products(rows: DataFrame, most: int) -> DataFrame:
    """(series, shift, product): the sum of x[t] * y[(t + shift) mod n] for every shift from 0 to n - 1.

    rows: (series, t, n, x, y) with t from 0 to n - 1; most: the greatest n. Products of whole numbers are whole as long as
    they stay far below 2^53."""
    bits = max(2 * most - 1, 4).bit_length()
    a, b = 1 << ((bits + 1) // 2), 1 << (bits // 2)
    m = a * b

    # t = low + a * high: along the high part, for each low part.
    def along_high(f: pd.DataFrame) -> pd.DataFrame:
        x, k = np.zeros((2, b), complex), np.arange(b)
        x[0, f["t"] // a], x[1, f["t"] // a] = f["x"], f["y"]
        low = int(f["t"].iloc[0]) % a
        z = np.fft.fft(x, axis=1) * _turn(low * k, m)
        return pd.DataFrame({"series": f["series"].iloc[0], "n": f["n"].iloc[0], "k": k, "low": low, "xr": z[0].real, "xi": z[0].imag, "yr": z[1].real, "yi": z[1].imag})

    first = rows.groupBy("series", (F.col("t") % a).alias("_low")).applyInPandas(along_high, _kind(rows) + ", n long, k long, low long, xr double, xi double, yr double, yi double")

    # Frequencies k + b * j for one k: the other half of the transform, the product, and the first half of the way back.
    def middle(f: pd.DataFrame) -> pd.DataFrame:
        k, x = int(f["k"].iloc[0]), np.zeros((2, a), complex)
        x[0, f["low"]], x[1, f["low"]] = f["xr"] + 1j * f["xi"], f["yr"] + 1j * f["yi"]
        z = np.fft.fft(x, axis=1)
        back = np.fft.fft(z[0] * np.conj(z[1]))  # the conjugate of the product, so that the way back is a transform too
        t = np.arange(a)
        back *= _turn(k * t, m)
        return pd.DataFrame({"series": f["series"].iloc[0], "n": f["n"].iloc[0], "low": t, "k": k, "re": back.real, "im": back.imag})

    second = first.groupBy("series", "k").applyInPandas(middle, _kind(rows) + ", n long, low long, k long, re double, im double")

    def last(f: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(b, complex)
        x[f["k"]] = f["re"] + 1j * f["im"]
        lag = int(f["low"].iloc[0]) + a * np.arange(b)
        n = int(f["n"].iloc[0])
        found = pd.DataFrame({"series": f["series"].iloc[0], "n": n, "shift": np.where(lag < n, lag, lag - m + n), "product": np.fft.fft(x).real / m})
        return found[(lag < n) | (lag > m - n)]

    # Lags of the padded series: those from the end are negative and go around.
    lags = second.groupBy("series", "low").applyInPandas(last, _kind(rows) + ", n long, shift long, product double")
    return lags.groupBy("series", "n", "shift").agg(F.sum("product").alias("product"))


def _kind(rows: DataFrame) -> str:
    return f"series {rows.schema['series'].dataType.simpleString()}"


def centred_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows with twice the average rank of a value in its series less its mean: a whole number, 0 in the mean."""
    ranked = numbered(rows, [value], ("series",), "_r")
    ties = temporary(ranked.groupBy("series", value).agg((F.min("_r") + F.max("_r")).alias("_two")), "ranks")
    return attached(ranked, ties, ("series", value)).withColumn(name, F.col("_two") - F.col("n") - 1).drop("_r", "_two")


def shift_test(rows: DataFrame, series: str, order: list[str], x: str, y: str) -> DataFrame:
    """(series, n, rho, reached, p): the rank correlation of x and y in each series, how many of the other n - 1 circular
    shifts of y reach it in absolute value, and (1 + reached) / n.

    Where a side is constant, rho is null and every shift reaches it. Rows must know both values."""
    plain = rows.select(F.col(series).alias("series"), *order, F.col(x).alias("_x"), F.col(y).alias("_y"))
    sizes = temporary(plain.groupBy("series").agg(F.count("*").alias("n")), "sizes")
    most = sizes.agg(F.coalesce(F.max("n"), F.lit(0))).head()[0]
    placed = attached(numbered(plain, order, ("series",), "t"), sizes, ("series",)).withColumn("t", F.col("t") - 1)
    ranks = temporary(centred_ranks(centred_ranks(placed, "_x", "x"), "_y", "y").select("series", "t", "n", "x", "y"), "shift-ranks")
    squares = ranks.groupBy("series").agg(F.sqrt(F.sum(F.col("x") * F.col("x")).cast("double") * F.sum(F.col("y") * F.col("y"))).alias("_scale"))
    products = temporary(circular_products(ranks, most).select("series", "n", "shift", F.round("product").cast("long").alias("product")), "products")
    own = products.where("shift = 0").select("series", F.col("product").alias("_zero"))
    facts = temporary(attached(own, temporary(squares, "scales"), ("series",)), "unshifted")
    found = attached(products, facts, ("series",))
    reached = F.count_if((F.col("shift") > 0) & (F.abs("product") >= F.abs("_zero")))
    out = found.groupBy("series", "n", "_zero", "_scale").agg(reached.alias("reached"))
    rho = F.when(F.col("_scale") > 0, F.col("_zero") / F.col("_scale"))
    return out.select(F.col("series").alias(series), "n", rho.alias("rho"), "reached", ((1 + F.col("reached")) / F.col("n")).alias("p"))
