"""Comparison of models on the sample they share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from monthloom.functions.numeric import is_close, level_ape
from monthloom.operators.checks import DataCheckError, duplicate_keys, require_none, require_rows
from monthloom.operators.evaluate import mae, rmse
from monthloom.operators.rules import Rule, check
from monthloom.operators.target import LEVEL_LAG, TARGET

TOLERANCE = 1e-9
# (entity, month) keys are unique within a model, so a key's partition has one row per model
def _by_key() -> WindowSpec:
    return Window.partitionBy("month", "entity")


def common_sample(predictions: DataFrame) -> DataFrame:
    """Predictions of the keys that every model covers."""
    n_models = predictions.agg(F.count_distinct("model").alias("n")).scalar()
    return (
        predictions.withColumn("_covered", F.count("model").over(_by_key()))
        .filter(F.col("_covered") == n_models)
        .drop("_covered")
    )


def disagreeing_actuals(common: DataFrame) -> DataFrame:
    """Keys for which the models were given different outcomes."""
    return (
        common.groupBy("month", "entity")
        .agg((F.max("actual") - F.min("actual")).alias("spread"))
        .filter(F.col("spread") > TOLERANCE)
    )


def widest_spread(common: DataFrame, column: str = "actual") -> DataFrame:
    """The one key over whose models the column spreads most; of equals the last."""
    spreads = common.groupBy("month", "entity").agg(
        (F.max(column) - F.min(column)).alias("spread")
    )
    key = F.struct("month", "entity", "spread")
    order = F.struct("spread", "month", "entity")
    return spreads.agg(F.max_by(key, order).alias("k")).select("k.*")


def rows_per_model(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def checked_common_sample(predictions: DataFrame) -> DataFrame:
    require_none(
        duplicate_keys(predictions, ("month", "entity", "model")).orderBy("month", "entity", "model"),
        "A model has two predictions for an entity and month.",
        examples=10,
    )
    if predictions.select("model").distinct().limit(2).count() < 2:
        raise DataCheckError("A comparison needs at least two models.")
    common = common_sample(predictions)
    require_rows(common, "The models share no entity and month.")
    require_none(
        disagreeing_actuals(common).orderBy(F.desc("spread")),
        "Models disagree on the outcome.",
        examples=1,
    )
    sizes = rows_per_model(common).agg(F.count_distinct("n").alias("sizes")).first().sizes
    if sizes != 1:
        raise DataCheckError("The models' common samples differ in size.")
    return common


def attach_levels(predictions: DataFrame, panel: DataFrame) -> DataFrame:
    """Reconstructed actual and forecast levels, from last month's level. Only panel rows
    of predicted months, a short list, enter the join."""
    months = F.broadcast(predictions.select("month").distinct())
    keys = panel.select(
        "month", "entity", LEVEL_LAG, F.col(TARGET).alias("panel_target")
    ).join(months, "month", "left_semi")
    return predictions.join(keys, ["month", "entity"], "left").withColumns(
        {
            "actual_level": F.col(LEVEL_LAG) + F.col("actual"),
            "prediction_level": F.col(LEVEL_LAG) + F.col("prediction"),
        }
    )


def level_rules() -> list[Rule]:
    """Every prediction has a panel row with the same outcome, and a positive level."""
    matched = F.col(LEVEL_LAG).isNotNull() & F.col("panel_target").isNotNull()
    key = ("month", "entity", "model")
    return [
        Rule("unmatched", "Some predictions have no panel row.", ~matched, key),
        Rule(
            "other_outcome",
            "The outcome of a prediction differs from the panel.",
            ~is_close(F.col("actual"), F.col("panel_target"), atol=TOLERANCE),
            (*key, "actual", "panel_target"),
        ),
        Rule(
            "level_not_positive",
            "Percentage errors need positive levels.",
            F.col("actual_level") <= 0,
            ("month", "entity"),
        ),
    ]


def check_levels(levels: DataFrame) -> None:
    check(levels, level_rules())


def level_metrics(levels: DataFrame) -> DataFrame:
    """RMSE and MAE of the change, MAPE of the level, and N, per model."""
    ape = F.abs(F.col("actual_level") - F.col("prediction_level")) / F.col("actual_level")
    return levels.groupBy("model").agg(
        rmse().alias("rmse"),
        mae().alias("mae"),
        F.avg(ape).alias("mape"),
        F.count(F.lit(1)).alias("n"),
    )


def ranking(metrics: DataFrame) -> DataFrame:
    """Comparison table, one row per model; equal RMSE shares a rank."""
    # unpartitioned on purpose: the input has one row per model
    return metrics.select(
        F.rank().over(Window.orderBy("rmse")).cast("bigint").alias("rank"),
        "model",
        "rmse",
        "mae",
        "mape",
        "n",
        F.lit("Common sample").alias("basis"),
    ).orderBy("rmse", "model")


def prediction_audit(levels: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """One row per prediction with its errors; in rank order when `ranked` is given."""
    error = F.col("actual") - F.col("prediction")
    audit = levels.select(
        "month",
        "entity",
        "model",
        "actual",
        "prediction",
        LEVEL_LAG,
        "actual_level",
        "prediction_level",
        F.abs(error).alias("absolute_error"),
        (error * error).alias("squared_error"),
        level_ape(F.col("actual_level"), F.col("prediction_level")).alias("level_ape"),
    )
    if ranked is None:
        return audit
    order = F.broadcast(ranked.select("model", "rank", "rmse"))
    return (
        audit.join(order, "model")
        .orderBy("rank", "rmse", "model", "month", "entity")
        .drop("rank", "rmse")
    )


def plot_metrics(ranked: DataFrame) -> DataFrame:
    """Long table of the three metrics for a bar chart, MAPE in percent."""
    shown = {"rmse": F.col("rmse"), "mae": F.col("mae"), "mape": F.col("mape") * 100.0}
    cells = [
        F.struct(F.lit(name).alias("metric"), value.alias("value"))
        for name, value in shown.items()
    ]
    return ranked.select("rank", "model", F.inline(F.array(*cells)))


def plot_series(levels: DataFrame, entities: Sequence[str]) -> DataFrame:
    """Actual and forecast levels of some entities with their chart's axis limits."""
    chosen = levels.filter(F.col("entity").isin(*entities))
    limits = chosen.groupBy("entity").agg(
        F.least(F.min("actual_level"), F.min("prediction_level")).alias("low"),
        F.greatest(F.max("actual_level"), F.max("prediction_level")).alias("high"),
    )
    margin = F.greatest((F.col("high") - F.col("low")) * 0.08, F.lit(0.25))
    return chosen.join(
        F.broadcast(
            limits.select(
                "entity",
                (F.col("low") - margin).alias("axis_low"),
                (F.col("high") + margin).alias("axis_high"),
            )
        ),
        "entity",
    ).select("entity", "model", "month", "actual_level", "prediction_level", "axis_low", "axis_high")


def check_plot_series(levels: DataFrame, entities: Sequence[str]) -> None:
    chosen = levels.filter(F.col("entity").isin(*entities))
    found = {r.entity for r in chosen.select("entity").distinct().collect()}
    missing = sorted(set(entities) - found)
    if missing:
        raise DataCheckError(f"No common-sample predictions for {missing}.")
    require_none(
        chosen.groupBy("entity", "month")
        .agg((F.max("actual_level") - F.min("actual_level")).alias("spread"))
        .filter(F.col("spread") > TOLERANCE),
        "Models disagree on the actual level.",
    )
