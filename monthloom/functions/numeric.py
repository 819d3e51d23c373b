"""Numeric helpers. Missing values are NULL everywhere; NaN never leaves an input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def is_finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) < F.lit(float("inf")))


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL for a zero or missing denominator."""
    return F.try_divide(numerator, denominator)


def log_floored(col: Column, floor: float) -> Column:
    """log(max(x, floor)); `greatest` skips NULLs, so NULL is kept explicitly."""
    return F.when(col.isNotNull(), F.log(F.greatest(col, F.lit(floor))))


def level_ape(actual: Column, predicted: Column, tiny: float = 1e-8) -> Column:
    """Absolute percentage error of a level, NULL when the level is about zero."""
    return F.when(F.abs(actual) > F.lit(tiny), F.abs((actual - predicted) / actual))


def round_half_up(col: Column, places: int) -> Column:
    """floor(x * 10^p + 1/2) / 10^p, the same arithmetic in every SQL engine."""
    scale = float(10**places)
    return F.floor(col * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
