"""Ranks and quantiles of the last L rows, at every row, in O(log L) steps a row.

Rows are laid out by ranges of (series, order); each part also gets the L rows before it. A part then goes through its rows
once with a tree of counts over the ranks of its values: a value that enters or leaves the frame changes log2 of the
counts, and a rank or an order statistic reads as many. No frame is gathered or sorted again. A series may lie on many
parts, a part may hold many series; what a task holds is one part with its halo.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import AT, PART, PART_ROWS, lay_out, with_halos


class Counts:
    """Counts of ranks 0 .. size - 1 as a tree of partial sums."""

    def __init__(self, size: int):
        self.size, self.n = size, 0
        self.top = 1 << (max(size, 1).bit_length() - 1)
        self.tree = [0] * (size + 1)

    def add(self, rank: int, by: int) -> None:
        self.n += by
        at, tree, size = rank + 1, self.tree, self.size
        while at <= size:
            tree[at] += by
            at += at & -at

    def below(self, rank: int) -> int:
        """How many have a lower rank."""
        total, tree = 0, self.tree
        while rank:
            total += tree[rank]
            rank &= rank - 1
        return total

    def nth(self, k: int) -> int:
        """The rank of the k-th lowest, from 0."""
        at, step, tree, size = 0, self.top, self.tree, self.size
        while step:
            ahead = at + step
            if ahead <= size and tree[ahead] <= k:
                at = ahead
                k -= tree[at]
            step >>= 1
        return at


def _scan(values: np.ndarray, series: np.ndarray, length: int, quantiles: tuple[float, ...]) -> tuple[np.ndarray, ...]:
    """For every row, over the rows of its series that are among the length rows before it: how many are known, how many
    of them are lower and how many equal, and the quantiles with interpolation."""
    known = ~np.isnan(values)
    levels, rank = np.unique(values[known], return_inverse=True)
    ranks = np.full(len(values), -1)
    ranks[known] = rank
    n, below, ties = (np.zeros(len(values), np.int64) for _ in range(3))
    out = np.full((len(quantiles), len(values)), np.nan)
    counts, first, before = Counts(len(levels)), 0, None
    listed = ranks.tolist()
    for k, (r, s) in enumerate(zip(listed, series.tolist())):
        if s != before:  # another series: its rows leave one by one
            while first < k:
                if listed[first] >= 0:
                    counts.add(listed[first], -1)
                first += 1
            before = s
        elif k - first > length:
            if listed[first] >= 0:
                counts.add(listed[first], -1)
            first += 1
        n[k] = counts.n
        if r >= 0:
            below[k] = counts.below(r)
            ties[k] = counts.below(r + 1) - below[k]
        if counts.n:
            for j, q in enumerate(quantiles):
                spot = q * (counts.n - 1)
                low = int(spot)
                a = levels[counts.nth(low)]
                out[j, k] = a if spot == low else a + (spot - low) * (levels[counts.nth(low + 1)] - a)
        if r >= 0:
            counts.add(r, 1)
    return n, below, ties, out


def rolling_order(rows: DataFrame, order: list[str | Column], value: Column, length: int, by: tuple[str, ...] = (), quantiles: tuple[float, ...] = (0.5,)) -> DataFrame:
    """rows with n_known, n_below, n_equal (long) and quantiles (an array, null without a known value): of the length rows
    before each row in its series, those with a known value, those of them below and equal to the row's own (0 if that is
    unknown), and the quantiles with linear interpolation. NaN counts as unknown."""
    laid = lay_out(rows.withColumn("_value", value.cast("double")), order, by, PART_ROWS)
    keys = F.xxhash64(*by) if by else F.lit(0).cast("long")
    near = with_halos(laid, length, 0, False).withColumn("_series", keys)
    added = [T.StructField(c, T.LongType()) for c in ("n_known", "n_below", "n_equal")] + [T.StructField("quantiles", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*rows.schema.fields, *added])
    names = rows.columns

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(AT, kind="stable")
        n, below, ties, q = _scan(f["_value"].to_numpy(float), f["_series"].to_numpy(), length, quantiles)
        f["n_known"], f["n_below"], f["n_equal"] = n, below, ties
        f["quantiles"] = [list(x) if c else None for x, c in zip(q.T, n)]
        return f.loc[f["_own"], [*names, "n_known", "n_below", "n_equal", "quantiles"]]

    return near.groupBy(PART).applyInPandas(run, schema)
