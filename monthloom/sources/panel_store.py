"""The modelling panel at rest: Parquet in ranges of months and entities.

Keys are columns of the files, never folder names, so their types are those written: an
entity '01' stays text and apart from '1'. Readers that want some months skip files and row
groups by their statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monthloom.functions.calendar import month_end
from monthloom.operators import packed
from monthloom.operators.checks import DataCheckError, require_columns
from monthloom.operators.rules import Rule, check, finite, unique, watched_by_key
from monthloom.operators.target import LEVEL, LEVEL_LAG, TARGET

_KEYS = ("month", "entity")


def write_panel(panel: DataFrame, path: str, csv: bool = False) -> None:
    """Sorted files; their number follows the size, not the number of entities."""
    if csv:
        panel.orderBy(*_KEYS).write.mode("overwrite").option("header", "true").csv(path)
        return
    _write(panel.repartitionByRange(*_KEYS).sortWithinPartitions(*_KEYS), path)


def _write(laid: DataFrame, path: str) -> None:
    laid.write.mode("overwrite").parquet(path)


def write_checked(
    panel: DataFrame, path: str, rules: Sequence[Rule], totals: dict[str, Column] | None = None
) -> dict:
    """Write the panel as `write_panel` does and count its rules on the way, unique keys
    included. Raises after the write if one is broken; returns the counters and totals."""
    found = watched_by_key(panel, rules, totals, _KEYS)
    _write(found.frame, path)
    return found.require(panel.sparkSession.read.schema(panel.schema).parquet(path))


def write_dictionaries(features: DataFrame, entities: DataFrame, path: str) -> None:
    """What the places of a packed panel mean, beside its rows: readers of rows skip them."""
    features.coalesce(1).write.mode("overwrite").parquet(f"{path}/_features")
    entities.coalesce(1).write.mode("overwrite").parquet(f"{path}/_entities")


def read_dictionaries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    read = spark.read.schema
    return (
        read("position int, feature string").parquet(f"{path}/_features"),
        read("position int, entity string").parquet(f"{path}/_entities"),
    )


def feature_columns(panel: DataFrame, target: str = TARGET) -> list[str]:
    """Everything but keys and target."""
    return [c for c in panel.columns if c not in (*_KEYS, target)]


def model_rules(features: Sequence[str], target: str = TARGET, finite_name: str = "not_finite") -> list[Rule]:
    """The rules on the rows of a modelling panel."""
    return [
        Rule("invalid_month", "The panel has invalid months.", F.col("month").isNull(), ("entity",)),
        unique("The panel repeats an entity and month."),
        finite(
            finite_name, "The panel has missing or non-finite values.", list(dict.fromkeys([*features, target]))
        ),
    ]


def check_model_panel(panel: DataFrame, target: str = TARGET) -> list[str]:
    """The rules of a modelling panel; returns its feature list."""
    if LEVEL in panel.columns:
        raise DataCheckError(
            f"The panel holds the current {LEVEL!r}, which gives the outcome away; keep only "
            f"{LEVEL_LAG!r}."
        )
    require_columns(panel, [*_KEYS, target, LEVEL_LAG], "The modelling panel")
    features = feature_columns(panel, target)
    text = [
        f.name
        for f in panel.schema.fields
        if f.name in features
        and not isinstance(f.dataType, T.NumericType)
        and not (f.name == packed.FEATURES and packed.is_packed(panel))
    ]
    if text:
        raise DataCheckError(f"Predictors must be numeric: {text[:10]}.")
    if packed.is_packed(panel):
        plain = [c for c in features if c != packed.FEATURES]
        check(panel, [*model_rules(plain, target, "other_not_finite"), *packed.packed_rules()])
    else:
        check(panel, model_rules(features, target))
    return features


def load_panel(
    spark: SparkSession, path: str, target: str = TARGET
) -> tuple[DataFrame, list[str]]:
    """The checked panel and its features."""
    panel = spark.read.parquet(path)
    return panel, check_model_panel(panel, target)


def load_panel_csv(
    spark: SparkSession, path: str, features: Sequence[str], target: str = TARGET
) -> tuple[DataFrame, list[str]]:
    """A CSV panel with an explicit schema, for exchange with other tools. Columns are
    taken by header name; the level column may not be among them."""
    header = spark.read.option("header", "true").csv(path).columns
    if LEVEL in header:
        check_model_panel(spark.read.option("header", "true").csv(path), target)
    numeric = {*features, target, LEVEL_LAG}
    schema = ", ".join(
        f"`{c}` {'date' if c == 'month' else 'double' if c in numeric else 'string'}"
        for c in header
    )
    panel = spark.read.schema(schema).option("header", "true").csv(path)
    return panel, check_model_panel(panel, target)


def level_keys(spark: SparkSession, path: str) -> DataFrame:
    """The four columns that the comparison needs; the scan reads only these."""
    keys = spark.read.parquet(path).select("month", "entity", LEVEL_LAG, TARGET)
    return keys.withColumn("month", month_end(F.col("month")))
