"""Random walk and pooled first-order autoregression over rolling splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthloom import params
from monthloom.operators.splits import test_rows
from monthloom.operators.target import LEVEL_LAG, TARGET
from monthloom.session import cut_lineage

RANDOM_WALK = "Random walk"
POOLED_AR = "AR(1)"
PREDICTION_COLUMNS = (
    "month", "entity", "model", "actual", "prediction", "train_start", "train_end",
)


def prediction_rows(test: DataFrame, model: str, actual: Column, prediction: Column) -> DataFrame:
    return test.select(
        "month",
        "entity",
        F.lit(model).alias("model"),
        actual.cast("double").alias("actual"),
        prediction.cast("double").alias("prediction"),
        "train_start",
        "train_end",
    )


def random_walk(indexed: DataFrame, splits: DataFrame, target: str = TARGET) -> DataFrame:
    """No change, for every test row that has a target."""
    test = test_rows(indexed.filter(F.col(target).isNotNull()), splits)
    return prediction_rows(test, RANDOM_WALK, F.col(target), F.lit(0.0))


def rolling_moments(
    rows: DataFrame, tests: DataFrame, window: int, by: Sequence[str] = ()
) -> DataFrame:
    """Moments of the `window` months before each test month, per entity (and `by`):
    (test_idx, entity, mean_x, mean_y, sxx, sxy), only where the window has rows.

    `rows` has (month_idx, entity, x, y). Every entity gets one row more per test month, which
    sums its frame; a partition is twice the calendar at most. No training row is copied, and
    an entity counts in a month it has no row in."""
    months = tests.agg(F.array_sort(F.collect_set("test_idx"))).scalar()
    wanted = (
        rows.select(*by, "entity")
        .distinct()
        .select(
            *by,
            "entity",
            F.explode(months).alias("month_idx"),
            F.lit(None).cast("double").alias("x"),
            F.lit(None).cast("double").alias("y"),
            F.lit(True).alias("asked"),
        )
    )
    held = rows.select(*by, "entity", "month_idx", "x", "y", F.lit(False).alias("asked"))
    frame = Window.partitionBy(*by, "entity").orderBy("month_idx").rangeBetween(-window, -1)
    return (
        held.unionByName(wanted)
        .select(
            *by,
            "entity",
            F.col("month_idx").alias("test_idx"),
            "asked",
            F.avg("x").over(frame).alias("mean_x"),
            F.avg("y").over(frame).alias("mean_y"),
            F.regr_sxx("y", "x").over(frame).alias("sxx"),
            F.regr_sxy("y", "x").over(frame).alias("sxy"),
        )
        .filter(F.col("asked") & F.col("mean_x").isNotNull())
        .drop("asked")
    )


def fixed_effect_forecasts(
    moments: DataFrame, test: DataFrame, keys: Sequence[str], reference: str
) -> DataFrame:
    """Least squares of y on x, entity dummies and an intercept, per `keys`, applied to
    the test rows; adds `slope`, `prediction` and `rank_deficient`. `moments` are those of
    the training rows per `keys` and entity.

    With a dummy per entity the fit separates: the slope comes from the within-entity
    moments and the forecast is mean(y) + slope * (x - mean(x)) of the row's entity. The
    rank-deficient cases give the least-squares solution with the smallest dummy and
    slope coefficients:
      - an entity without training rows is read off the anchor, that is the reference
        entity's means, or the plain average of the entity means without it;
      - when x does not vary within any entity, the slope is shared between x and the
        dummies.
    """
    moments = cut_lineage(moments)  # read twice
    is_reference = F.col("entity") == reference
    mx, my = F.col("mean_x"), F.col("mean_y")
    pooled = (
        moments.groupBy(*keys)
        .agg(
            F.sum("sxx").alias("within_xx"),
            F.sum("sxy").alias("within_xy"),
            F.coalesce(F.max(F.when(is_reference, mx)), F.avg(mx)).alias("anchor_x"),
            F.coalesce(F.max(F.when(is_reference, my)), F.avg(my)).alias("anchor_y"),
            F.max(is_reference.cast("int")).alias("has_reference"),
            F.count(F.lit(1)).alias("n"),
            F.sum(mx).alias("sum_x"),
            F.sum(my).alias("sum_y"),
            F.sum(mx * my).alias("sum_xy"),
            F.sum(mx * mx).alias("sum_xx"),
        )
        .withColumn(
            "between_xy",
            F.expr("sum_xy - anchor_y * sum_x - anchor_x * sum_y + n * anchor_x * anchor_y"),
        )
        .withColumn(
            "between_xx", F.expr("sum_xx - 2 * anchor_x * sum_x + n * anchor_x * anchor_x")
        )
        .withColumn(
            "slope",
            F.when(F.col("within_xx") > 0, F.try_divide("within_xy", "within_xx")).otherwise(
                F.col("between_xy") / (1.0 + F.col("between_xx"))
            ),
        )
        .select(*keys, "slope", "anchor_x", "anchor_y", "has_reference", "within_xx")
    )
    joined = test.join(
        moments.select(*keys, "entity", "mean_x", "mean_y"), [*keys, "entity"], "left"
    ).join(pooled, list(keys))
    centre_x = F.coalesce("mean_x", "anchor_x")
    centre_y = F.coalesce("mean_y", "anchor_y")
    return joined.withColumn(
        "prediction", centre_y + F.col("slope") * (F.col("x") - centre_x)
    ).withColumn(
        "rank_deficient",
        F.col("mean_x").isNull() | (F.col("within_xx") <= 0) | (F.col("has_reference") == 0),
    )


def pooled_ar_fits(
    indexed: DataFrame,
    splits: DataFrame,
    window: int,
    regressor: str = LEVEL_LAG,
    target: str = TARGET,
    reference: str = params.REFERENCE_ENTITY,
) -> DataFrame:
    """One row per test row with the fitted slope, the forecast and the rank flag."""
    narrow = indexed.select(
        "month_idx", "month", "entity", F.col(regressor).alias("x"), F.col(target).alias("y")
    ).dropna(subset=["x", "y"])
    moments = rolling_moments(narrow, splits, window)
    return fixed_effect_forecasts(moments, test_rows(narrow, splits), ["test_idx"], reference)


def pooled_ar(
    indexed: DataFrame,
    splits: DataFrame,
    window: int,
    regressor: str = LEVEL_LAG,
    model: str = POOLED_AR,
    target: str = TARGET,
    reference: str = params.REFERENCE_ENTITY,
) -> DataFrame:
    fits = pooled_ar_fits(indexed, splits, window, regressor, target, reference)
    return prediction_rows(fits, model, F.col("y"), F.col("prediction"))
