"""Rates joined to the panel: isolated gaps filled, lag and one-month change.

All windows are partitioned by entity and ordered by month, over unique keys, so a
partition holds at most one row per month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from monthloom.functions.calendar import month_ordinal
from monthloom.operators.checks import duplicate_keys, require_none, require_rows

TARGET = "target"
LEVEL = "level"
LEVEL_LAG = "level_lag1"

def _by_month() -> WindowSpec:
    return Window.partitionBy("entity").orderBy("month")


def entities_without_rates(panel: DataFrame, rates: DataFrame) -> DataFrame:
    return (
        panel.select("entity").distinct().join(rates.select("entity"), "entity", "left_anti")
    )


def attach_rates(panel: DataFrame, rates: DataFrame, check: bool = True) -> DataFrame:
    """Panel with the `level` of its entity and month, one to one."""
    if check:
        require_none(
            entities_without_rates(panel, rates).orderBy("entity"),
            "Entities of the panel have no rates.",
        )
        require_none(duplicate_keys(panel), "The panel repeats an entity and month.")
        require_none(duplicate_keys(rates), "The rates repeat an entity and month.")
    return panel.join(rates.select("entity", "month", LEVEL), ["entity", "month"], "left")


def fill_isolated_gaps(combined: DataFrame) -> DataFrame:
    """Fill a missing level by the mean of its neighbours when both are present and one
    calendar month away. Adds `imputed`. Longer gaps stay, as only original neighbours
    count."""
    before, after = F.lag(LEVEL).over(_by_month()), F.lead(LEVEL).over(_by_month())
    here = month_ordinal(F.col("month"))
    step_back = here - month_ordinal(F.lag("month").over(_by_month()))
    step_on = month_ordinal(F.lead("month").over(_by_month())) - here
    fills = (
        F.col(LEVEL).isNull()
        & before.isNotNull()
        & after.isNotNull()
        & (step_back == 1)
        & (step_on == 1)
    )
    return (
        combined.withColumns(
            {"imputed": F.coalesce(fills, F.lit(False)), "_mean": (before + after) / F.lit(2.0)}
        )
        .withColumn(LEVEL, F.when(F.col("imputed"), F.col("_mean")).otherwise(F.col(LEVEL)))
        .drop("_mean")
    )


def imputed_rates(filled: DataFrame) -> DataFrame:
    return filled.filter("imputed").select("entity", "month", F.col(LEVEL).alias("imputed_value"))


def remaining_gaps(filled: DataFrame) -> DataFrame:
    return filled.filter(F.col(LEVEL).isNull()).select("entity", "month")


def gap_audit(filled: DataFrame) -> DataFrame:
    """One row per entity and status with the number of months and their span."""
    status = F.when(F.col("imputed"), "filled").when(F.col(LEVEL).isNull(), "remaining")
    return (
        filled.withColumn("status", status)
        .filter(F.col("status").isNotNull())
        .groupBy("entity", "status")
        .agg(
            F.count(F.lit(1)).alias("n_months"),
            F.min("month").alias("first_month"),
            F.max("month").alias("last_month"),
        )
    )


def add_change(filled: DataFrame) -> DataFrame:
    """`level_lag1` (adjacent months only) and `target`; the level itself is removed,
    as it would give the outcome away."""
    adjacent = (
        month_ordinal(F.col("month")) - month_ordinal(F.lag("month").over(_by_month()))
    ) == 1
    lagged = F.when(adjacent, F.lag(LEVEL).over(_by_month()))
    return (
        filled.withColumn(LEVEL_LAG, lagged)
        .withColumn(TARGET, F.col(LEVEL) - F.col(LEVEL_LAG))
        .drop(LEVEL, "imputed")
    )


def with_target(changed: DataFrame) -> DataFrame:
    return changed.dropna(subset=[TARGET, LEVEL_LAG])


def combine(panel: DataFrame, rates: DataFrame) -> DataFrame:
    """The checked modelling panel: panel, `level_lag1` and `target`."""
    result = with_target(add_change(fill_isolated_gaps(attach_rates(panel, rates))))
    require_rows(result, "No row has a target.")
    return result
