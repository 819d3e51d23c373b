"""Helpers for array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once.

    An expression that a lambda over an array refers to is evaluated per element once
    the optimizer has merged the projections; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def mean(arr: Column) -> Column:
    return F.try_divide(total(arr), F.size(arr).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))
