"""Panels with all features of a row in one array, and dictionaries of what its places mean.

A plan over such a panel has the same size for six features and for a hundred thousand. Names
are a table of (position, feature); entities one of (position, entity), the reference first:
dummies are made of an entity's position when a design is built. Neither list comes to the
driver. A wide panel, one column per feature, is an export for named features.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monthloom import params
from monthloom.functions.calendar import month_end
from monthloom.functions.numeric import is_finite, nan_to_null
from monthloom.operators.panel import DUMMY_PREFIX
from monthloom.operators.rules import Rule

FEATURES = "features"


def is_packed(panel: DataFrame) -> bool:
    fields = {f.name: f.dataType for f in panel.schema.fields}
    return isinstance(fields.get(FEATURES), T.ArrayType)


def _numbered(names: DataFrame, column: str, *order) -> DataFrame:
    """A dictionary: as long as the panel is wide, so numbered in one piece."""
    place = F.row_number().over(Window.orderBy(*order)) - 1
    return names.select(place.alias("position"), column)


def feature_dictionary(long: DataFrame) -> DataFrame:
    return _numbered(long.select("feature").distinct(), "feature", "feature")


def entity_dictionary(rows: DataFrame, reference: str = params.REFERENCE_ENTITY) -> DataFrame:
    """Entities by name, the reference first where it occurs: the first has no dummy."""
    return _numbered(rows.select("entity").distinct(), "entity", F.col("entity") != reference, "entity")


def pack_panel(long: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(month end, entity, features): rows with a value for every feature of the dictionary."""
    size = dictionary.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        long.withColumn("value", nan_to_null(F.col("value")))
        .filter(F.col("value").isNotNull())
        .join(dictionary, "feature")
        .groupBy(month_end(F.col("month")).alias("month"), "entity")
        .agg(F.sort_array(F.collect_list(F.struct("position", "value"))).alias("cells"))
        .filter(F.size("cells") == size)
        .select("month", "entity", F.col("cells.value").alias(FEATURES))
    )


def packed_rules(dictionary: DataFrame | None = None, excluded: Sequence[str] = ()) -> list[Rule]:
    """Every row has a finite value at every position, and no excluded entity is there. Given
    the dictionary, the arrays must be as long as it is."""
    bad = F.exists(FEATURES, lambda x: ~is_finite(x))
    rules = [
        Rule("not_finite", "The panel has missing or non-finite features.", F.col(FEATURES).isNull() | bad),
        Rule(
            "excluded_entity",
            "Excluded entities are still in the panel.",
            F.col("entity").isin(*excluded) if excluded else F.lit(False),
            ("entity",),
        ),
    ]
    if dictionary is not None:
        size = dictionary.count()
        rules.append(
            Rule("other_length", "A row has not one value per feature.", F.size(FEATURES) != F.lit(size))
        )
    return rules


def unpacked(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Long form: (entity, month, feature, value)."""
    return rows.select("entity", "month", F.posexplode(FEATURES).alias("position", "value")).join(
        dictionary, "position"
    ).select("entity", "month", "feature", "value")


def wide(rows: DataFrame, dictionary: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named features as columns, for tools that want them; their positions are looked up."""
    found = {r.feature: r.position for r in dictionary.where(F.col("feature").isin(*names)).collect()}
    if missing := sorted(set(names) - set(found)):
        raise ValueError(f"The panel lacks the features {missing[:10]}.")
    columns = [F.get(FEATURES, F.lit(found[n])).alias(n) for n in names]
    return rows.select(*(c for c in rows.columns if c != FEATURES), *columns)


def design(rows: DataFrame, entities: DataFrame, more: Sequence[str]) -> DataFrame:
    """`features_vec`: features, dummies of the entity, then the columns `more`, as one vector."""
    count, own, none = entities.count(), F.col("_entity"), F.array().cast("array<double>")
    dummies = none
    if count > 1:
        places = F.sequence(F.lit(1), F.lit(count - 1))
        dummies = F.transform(places, lambda i: (i == own).cast("double"))
    others = F.array(*(F.col(c).cast("double") for c in more)) if more else none
    joined = rows.join(entities.withColumnRenamed("position", "_entity"), "entity")
    return joined.withColumn("features_vec", array_to_vector(F.concat(FEATURES, dummies, others))).drop(
        "_entity", FEATURES
    )


def design_names(dictionary: DataFrame, entities: DataFrame, more: Sequence[str]) -> DataFrame:
    """(position, feature) of the places of `design`'s vector."""
    n_features, n_entities = (d.agg(F.count(F.lit(1)).alias("n")).scalar() for d in (dictionary, entities))
    dummies = entities.where("position > 0").select(
        (F.col("position") - 1 + n_features).cast("int").alias("position"),
        F.concat(F.lit(DUMMY_PREFIX), "entity").alias("feature"),
    )
    named = dictionary.select(F.col("position").cast("int").alias("position"), "feature").unionByName(dummies)
    if not more:
        return named
    last = rows_of(dictionary, list(enumerate(more))).select(
        (F.col("position") + n_features + F.greatest(n_entities - 1, F.lit(0))).cast("int").alias("position"), "feature"
    )
    return named.unionByName(last)


def rows_of(like: DataFrame, pairs: list[tuple[int, str]]) -> DataFrame:
    return like.sparkSession.createDataFrame(pairs, "position int, feature string")
