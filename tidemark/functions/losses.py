"""Forecast losses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def qlike(actual: Column, forecast: Column) -> Column:
    ratio = F.try_divide(actual, forecast)
    return ratio - F.log(ratio) - 1


def squared(actual: Column, forecast: Column) -> Column:
    return (actual - forecast) * (actual - forecast)


def absolute(actual: Column, forecast: Column) -> Column:
    return F.abs(actual - forecast)


LOSSES = {"mse": squared, "mae": absolute, "qlike": qlike}


def improvement(base: Column, better: Column) -> Column:
    """Share of the base loss that the other saves; null if the base is 0."""
    return F.try_divide(base - better, base)


def clark_west(actual: Column, base: Column, enhanced: Column) -> Column:
    """The adjusted loss difference of nested forecasts, on logs."""
    y, b, e = F.log(actual), F.log(base), F.log(enhanced)
    return (y - b) * (y - b) - (y - e) * (y - e) + (b - e) * (b - e)
