"""Balanced entity-by-month panel and its checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom import params
from monthloom.functions.calendar import month_end
from monthloom.functions.numeric import nan_to_null
from monthloom.operators.checks import DataCheckError, any_of
from monthloom.operators.coverage import require_equal_coverage
from monthloom.operators.rules import Rule, check, finite, unique

DUMMY_PREFIX = "C_"


def feature_names(long: DataFrame) -> list[str]:
    """The sorted feature list. It becomes the panel's columns, so it is schema-sized."""
    return [r.feature for r in long.select("feature").distinct().orderBy("feature").collect()]


def entity_names(long: DataFrame) -> list[str]:
    return [r.entity for r in long.select("entity").distinct().orderBy("entity").collect()]


def panel_vectors(long: DataFrame, features: Sequence[str]) -> DataFrame:
    """(entity, month end, features, n_present): values in the order of `features`.

    One shuffle, in which a feature travels as its position and not as its name. A row's
    array is complete, hence aligned with the list, when `n_present` equals its length.
    """
    positions = long.sparkSession.createDataFrame(
        list(enumerate(features)), "position int, feature string"
    )
    cell = F.struct("position", "value")
    return (
        long.withColumn("value", nan_to_null(F.col("value")))
        .filter(F.col("value").isNotNull())
        .join(F.broadcast(positions), "feature")
        .groupBy("entity", month_end(F.col("month")).alias("month"))
        .agg(F.array_sort(F.collect_list(cell)).alias("cells"))
        .select(
            "entity",
            "month",
            F.col("cells.value").alias("features"),
            F.size("cells").alias("n_present"),
        )
    )


def incomplete_rows(long: DataFrame, n_features: int) -> DataFrame:
    """Number of (entity, month) rows that the panel drops for a missing feature."""
    present = F.count(nan_to_null(F.col("value")))
    return (
        long.groupBy("entity", month_end(F.col("month")).alias("month"))
        .agg(present.alias("n_present"))
        .agg(F.count_if(F.col("n_present") < n_features).alias("rows_dropped"))
    )


def dummy_order(entities: Sequence[str], reference: str) -> list[str]:
    """Reference entity first when it is there, else plain order; the first has no dummy."""
    ordered = sorted(entities)
    if reference in ordered:
        return [reference] + [e for e in ordered if e != reference]
    return ordered


def dummies(entities: Sequence[str], reference: str) -> list[Column]:
    return [
        (F.col("entity") == e).cast("int").alias(f"{DUMMY_PREFIX}{e}")
        for e in dummy_order(entities, reference)[1:]
    ]


def balanced_panel(
    long: DataFrame,
    features: Sequence[str],
    entities: Sequence[str],
    reference: str = params.REFERENCE_ENTITY,
) -> DataFrame:
    """Wide panel: month end, entity, one column per feature, entity dummies. Rows with
    a missing feature are dropped."""
    names = sorted(features)
    complete = panel_vectors(long, names).filter(F.col("n_present") == len(names))
    columns = [F.get("features", F.lit(i)).alias(name) for i, name in enumerate(names)]
    return complete.select("month", "entity", *columns, *dummies(entities, reference))


def build_panel(
    long: DataFrame, reference: str = params.REFERENCE_ENTITY
) -> tuple[DataFrame, list[str]]:
    """Check the coverage, then build the panel of all entities and features."""
    require_equal_coverage(long)
    features = feature_names(long)
    panel = balanced_panel(long, features, entity_names(long), reference)
    if panel.isEmpty():
        raise DataCheckError("No complete entity-month remains after the transforms.")
    return panel, features


def panel_summary(panel: DataFrame, features: Sequence[str], target: str | None = None) -> DataFrame:
    """One row: entities, features, dummies, rows, span and, if given, target range."""
    n_dummies = sum(c.startswith(DUMMY_PREFIX) for c in panel.columns)
    extra = [] if target is None else [
        F.min(target).alias("target_min"),
        F.max(target).alias("target_max"),
    ]
    return panel.agg(
        F.count_distinct("entity").alias("n_entities"),
        F.lit(len(features)).cast("bigint").alias("n_features"),
        F.lit(n_dummies).cast("bigint").alias("n_dummies"),
        F.count(F.lit(1)).alias("n_rows"),
        F.min("month").alias("first_month"),
        F.max("month").alias("last_month"),
        *extra,
    )


def panel_rules(
    panel: DataFrame,
    features: Sequence[str],
    excluded: Sequence[str] = params.EXCLUDED_ENTITIES,
) -> list[Rule]:
    """Excluded entities are absent, each row's dummies are those of its entity, and every
    feature is finite."""
    marked = [c for c in panel.columns if c.startswith(DUMMY_PREFIX)]
    wrong = [
        ~F.col(f"`{c}`").eqNullSafe((F.col("entity") == c[len(DUMMY_PREFIX) :]).cast("int"))
        for c in marked
    ]
    return [
        Rule(
            "excluded_entity",
            "Excluded entities are still in the panel.",
            F.col("entity").isin(*excluded),
            ("entity",),
        ),
        Rule(
            "wrong_dummies",
            "The dummies of a row are not those of its entity.",
            any_of(wrong) if wrong else F.lit(False),
        ),
        finite("not_finite", "The panel has missing or non-finite features.", features),
    ]


def combined_rules(
    panel: DataFrame,
    features: Sequence[str],
    target: str,
    excluded: Sequence[str] = params.EXCLUDED_ENTITIES,
) -> list[Rule]:
    """The rules of the panel, unique keys, and a finite target and lag."""
    others = [c for c in panel.columns if c not in ("entity", "month", *features)]
    return [
        unique("The panel repeats an entity and month."),
        *panel_rules(panel, features, excluded),
        finite(
            "target_not_finite",
            "The combined panel has missing or non-finite values.",
            list(dict.fromkeys([*others, target])),
        ),
    ]


def shape_totals(target: str | None = None) -> dict[str, Column]:
    """Totals that ride along: entities (as many as dummy columns, and one), span, target."""
    found = {
        "n_entities": F.size(F.collect_set("entity")),
        "first_month": F.min("month"),
        "last_month": F.max("month"),
    }
    if target is not None:
        found |= {"target_min": F.min(target), "target_max": F.max(target)}
    return found


def require_dummies(panel: DataFrame, n_entities: int) -> None:
    n_dummies = sum(c.startswith(DUMMY_PREFIX) for c in panel.columns)
    if n_dummies != max(n_entities - 1, 0):
        raise DataCheckError(f"Expected {n_entities - 1} dummies, found {n_dummies}.")


def _check(panel: DataFrame, rules: list[Rule]) -> None:
    found = check(panel, rules, {"n_entities": F.count_distinct("entity")})
    require_dummies(panel, found["n_entities"])


def check_panel(
    panel: DataFrame,
    features: Sequence[str],
    excluded: Sequence[str] = params.EXCLUDED_ENTITIES,
) -> None:
    """The rules of a panel at rest, in one job."""
    _check(
        panel,
        [unique("The panel repeats an entity and month."), *panel_rules(panel, features, excluded)],
    )


def check_combined(panel: DataFrame, features: Sequence[str], target: str) -> None:
    _check(panel, combined_rules(panel, features, target))
