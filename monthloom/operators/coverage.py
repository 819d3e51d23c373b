"""Calendar and feature coverage of a long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.functions.calendar import month_text
from monthloom.operators.checks import DataCheckError, require_none
from monthloom.operators.series import SERIES


def calendar_array(long: DataFrame) -> Column:
    """Scalar subquery: every month from the first to the last of the whole table."""
    return (
        long.agg(
            F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month")).alias("m")
        )
        .select("m")
        .scalar()
    )


def skeleton(long: DataFrame) -> DataFrame:
    """Every series crossed with every month of the common calendar."""
    months = calendar_array(long)
    return long.select(*SERIES).distinct().withColumn("month", F.explode(months))


def _missing_months(long: DataFrame) -> DataFrame:
    observed = F.when(F.col("value").isNotNull(), F.col("month"))
    return (
        long.groupBy(*SERIES)
        .agg(F.collect_set(observed).alias("present"))
        .withColumn("missing", F.array_except(calendar_array(long), F.col("present")))
        .filter(F.size("missing") > 0)
    )


def calendar_gaps(long: DataFrame) -> DataFrame:
    """(entity, feature, kind, month) cells without a value. One shuffle on the series
    key; the expected months are subtracted as arrays, so no skeleton is built."""
    return _missing_months(long).select(*SERIES, F.explode("missing").alias("month"))


def missing_counts(long: DataFrame) -> DataFrame:
    """Number of missing months of every incomplete series."""
    return _missing_months(long).select(
        *SERIES,
        F.size("missing").cast("bigint").alias("n_missing"),
        F.array_min("missing").alias("first_missing"),
        F.array_max("missing").alias("last_missing"),
    )


def top_missing(long: DataFrame, n: int = 10) -> DataFrame:
    """The report's top-n series by missing months."""
    return missing_counts(long).orderBy(F.desc("n_missing"), "entity", "feature").limit(n)


def require_complete_calendar(long: DataFrame) -> None:
    require_none(
        top_missing(long).withColumn("first_missing", month_text(F.col("first_missing"))),
        "Trend removal needs every series on the complete common calendar.",
        examples=10,
    )


# ------------------------------------------------------------ feature coverage


def _entity_features(long: DataFrame) -> DataFrame:
    return long.select("entity", "feature").distinct()


def feature_coverage(long: DataFrame) -> DataFrame:
    """Per entity: number of features, missing ones (in the union but not here) and
    extra ones (here but not common to all entities)."""
    pairs = _entity_features(long)
    per_feature = pairs.groupBy("feature").agg(F.count(F.lit(1)).alias("n_entities"))
    n_entities = long.agg(F.count_distinct("entity").alias("n")).scalar()
    n_union = per_feature.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        pairs.join(per_feature, "feature")
        .groupBy("entity")
        .agg(
            F.count(F.lit(1)).alias("n_features"),
            F.count_if(F.col("n_entities") < n_entities).alias("n_extra"),
        )
        .select("entity", "n_features", (n_union - F.col("n_features")).alias("n_missing"), "n_extra")
    )


def feature_gaps(long: DataFrame) -> DataFrame:
    """(entity, feature) pairs that the panel would need and the table lacks.

    Only incomplete features are expanded, each against the entities it lacks. The
    entity list is as long as the panel's dummy columns, hence a schema-sized array.
    """
    entities = long.agg(F.array_sort(F.collect_set("entity")).alias("e")).scalar()
    return (
        _entity_features(long)
        .groupBy("feature")
        .agg(F.collect_set("entity").alias("present"))
        .select("feature", F.explode(F.array_except(entities, F.col("present"))).alias("entity"))
        .select("entity", "feature")
    )


def require_equal_coverage(long: DataFrame) -> None:
    uneven = feature_coverage(long).filter("n_missing > 0 or n_extra > 0")
    if uneven.isEmpty():
        return
    examples = [
        f"{r.entity}:{r.feature}"
        for r in feature_gaps(long).orderBy("entity", "feature").limit(5).collect()
    ]
    rows = uneven.orderBy("entity").limit(5).collect()
    lines = [f"{r.entity}: {r.n_features} features, {r.n_missing} missing" for r in rows]
    raise DataCheckError(
        f"Entities differ in their features. {'; '.join(lines)}. Missing: {examples}"
    )
