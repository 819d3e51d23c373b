"""Forecast errors and their summaries; every summary is one partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_errors(predictions: DataFrame) -> DataFrame:
    error = F.col("actual") - F.col("prediction")
    return predictions.withColumns(
        {"error": error, "absolute_error": F.abs(error), "squared_error": error * error}
    )


def rmse() -> Column:
    error = F.col("actual") - F.col("prediction")
    return F.sqrt(F.avg(error * error))


def mae() -> Column:
    return F.avg(F.abs(F.col("actual") - F.col("prediction")))


def r2() -> Column:
    """1 - SSE/SST; NULL for a single row; for constant actuals 1 if exact, else 0."""
    error = F.col("actual") - F.col("prediction")
    sse, n = F.sum(error * error), F.count(F.lit(1))
    sst = F.var_pop("actual") * n
    flat = F.max("actual") == F.min("actual")
    return (
        F.when(n < 2, F.lit(None))
        .when(flat, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(F.lit(1.0) - F.try_divide(sse, sst))
    )


def _metrics() -> list[Column]:
    return [
        mae().alias("mae"),
        rmse().alias("rmse"),
        r2().alias("r2"),
        F.count(F.lit(1)).alias("n"),
    ]


def metrics_overall(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("model").agg(*_metrics()).orderBy("rmse", "model")


def metrics_by_entity(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("model", "entity").agg(*_metrics()).orderBy("model", "entity")


def metrics_all(predictions: DataFrame) -> DataFrame:
    """Both tables in one pass over the predictions; `entity` is NULL overall."""
    model, entity = F.col("model"), F.col("entity")
    return predictions.groupingSets([[model], [model, entity]], model, entity).agg(
        F.grouping(entity).cast("int").alias("overall"), *_metrics()
    )
