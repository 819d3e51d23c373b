"""Data-quality rules. A rule is a DataFrame of violations; `require_none` turns
a non-empty one into an error that carries a few example rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.functions.numeric import is_finite

KEY = ("entity", "month")


class DataCheckError(ValueError):
    """A data rule is violated."""


def require_none(violations: DataFrame, message: str, examples: int = 5) -> None:
    """Raise when the rule is violated. Only `examples` rows reach the driver."""
    rows = violations.limit(examples).collect()
    if rows:
        shown = "; ".join(
            ", ".join(f"{k}={v}" for k, v in row.asDict().items()) for row in rows
        )
        raise DataCheckError(f"{message} Examples: {shown}")


def require_rows(df: DataFrame, message: str) -> None:
    if df.isEmpty():
        raise DataCheckError(message)


def require_columns(df: DataFrame, required: Iterable[str], what: str) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise DataCheckError(f"{what} lacks the columns {missing}.")


def duplicate_keys(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def any_of(tests: Sequence[Column]) -> Column:
    """`or` as a balanced tree, which keeps very wide panels within the parser's depth."""
    tests = list(tests)
    while len(tests) > 1:
        tests = [
            reduce(lambda a, b: a | b, tests[i : i + 8]) for i in range(0, len(tests), 8)
        ]
    return tests[0]


def not_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which any of the columns is missing, NaN or infinite."""
    if not columns:
        return df.limit(0)
    return df.filter(any_of([~is_finite(F.col(f"`{c}`")) for c in columns]))


def unexpected_dimension_values(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Per dimension: every value that is not the expected one (NULLs ignored), and
    the expected value when it does not occur at all."""
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("dimension"), F.col(name).cast("string").alias("value"))
            for name in expected
        ]
    )
    counts = (
        df.select(F.explode(pairs).alias("p"))
        .select("p.dimension", "p.value")
        .filter(F.col("value").isNotNull())
        .groupBy("dimension", "value")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    wanted = df.sparkSession.createDataFrame(
        sorted(expected.items()), "dimension string, expected string"
    )
    found = wanted.join(
        counts,
        (wanted["dimension"] == counts["dimension"]) & (wanted["expected"] == counts["value"]),
        "left",
    ).select(wanted["dimension"], "expected", "n_rows")
    surplus = (
        counts.join(F.broadcast(wanted), "dimension")
        .filter(F.col("value") != F.col("expected"))
        .select("dimension", "value", "n_rows")
    )
    absent = found.filter(F.col("n_rows").isNull()).select(
        "dimension", F.col("expected").alias("value"), F.lit(0).cast("bigint").alias("n_rows")
    )
    return surplus.unionByName(absent)
