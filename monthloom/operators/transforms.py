"""Logs and yearly log changes on packed series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom import params
from monthloom.functions.arrays import let
from monthloom.functions.numeric import log_floored
from monthloom.operators.series import SERIES


def log_transforms(
    packed: DataFrame, lag: int = params.YOY_LAG, floor: float = params.LOG_FLOOR
) -> DataFrame:
    """Topics as log levels, categories as log changes over `lag` rows.

    The lag counts rows, which equals months on the complete calendar that the trend
    removal requires; the first `lag` values of a category are missing.
    """
    def by_kind(logs: Column) -> Column:
        change = F.transform(
            logs, lambda x, i: F.when(i >= lag, x - F.get(logs, i - F.lit(lag)))
        )
        return F.when(F.col("kind") == "topic", logs).otherwise(change)

    logs = F.transform("values", lambda v: log_floored(v, floor))
    return packed.select(*SERIES, "months", let(logs, by_kind).alias("values"))
