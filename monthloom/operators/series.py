"""Two forms of a set of monthly series.

long    (entity, feature, kind, month, value), one row per observation
packed  (entity, feature, kind, months, values), one row per series

A packed row holds one calendar's worth of values, so its size is bounded by the
number of months however much data there is. Break adjustment, shift, trend and
log transforms run on packed rows: one shuffle on the series key builds them, and
everything that follows up to the entity level is a narrow stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.functions.numeric import nan_to_null

SERIES = ("entity", "feature", "kind")


def observations() -> Column:
    """Aggregate: the series' observed (month, value) pairs in month order."""
    pair = F.struct(F.col("month").alias("month"), F.col("value").alias("value"))
    return F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), pair)))


def pack(long: DataFrame) -> DataFrame:
    """Long to packed; missing values (NULL or NaN) are left out. Needs unique
    (entity, feature, month) keys, which the sources check."""
    clean = long.withColumn("value", nan_to_null(F.col("value").cast("double")))
    return clean.groupBy(*SERIES).agg(observations().alias("obs")).select(
        *SERIES, F.col("obs.month").alias("months"), F.col("obs.value").alias("values")
    )


def unpack(packed: DataFrame, *columns: str) -> DataFrame:
    """Packed to long, for one or several array columns aligned with `months`."""
    columns = columns or ("values",)
    zipped = F.arrays_zip(F.col("months"), *[F.col(c) for c in columns])
    names = {"values": "value"}
    return packed.select(*SERIES, F.explode(zipped).alias("o")).select(
        *SERIES,
        F.col("o.months").alias("month"),
        *[F.col(f"o.{c}").alias(names.get(c, c)) for c in columns],
    )
