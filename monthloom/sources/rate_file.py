"""The rate file: one level per entity and month, strictly checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom import params
from monthloom.functions.calendar import month_end, parse_month
from monthloom.functions.text import parse_number
from monthloom.operators.checks import (
    duplicate_keys,
    require_columns,
    require_none,
    unexpected_dimension_values,
)

_CORE = ("REF_AREA", "TIME_PERIOD", "OBS_VALUE")


def read_rate_rows(spark: SparkSession, path: str, dimensions: dict[str, str]) -> DataFrame:
    """All required columns as text. The header decides the column order, so only
    the header line is read before the explicit schema is laid down."""
    header = spark.read.option("header", "true").csv(path).columns
    schema = ", ".join(f"`{name}` string" for name in header)
    rows = spark.read.schema(schema).option("header", "true").csv(path)
    required = [*_CORE, *dimensions]
    require_columns(rows, required, "The rate file")
    return rows.select(*required)


def area_map(spark: SparkSession, mapping: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(mapping.items()), "REF_AREA string, entity string")


def unmapped_areas(rows: DataFrame, areas: DataFrame) -> DataFrame:
    return (
        rows.filter(F.col("REF_AREA").isNotNull())
        .select("REF_AREA")
        .distinct()
        .join(areas, "REF_AREA", "left_anti")
    )


def to_rates(rows: DataFrame, areas: DataFrame) -> DataFrame:
    """(entity, month, level) with the month's last day; bad cells are NULL."""
    return rows.join(F.broadcast(areas), "REF_AREA", "left").select(
        "entity",
        month_end(parse_month(F.col("TIME_PERIOD"))).alias("month"),
        parse_number(F.col("OBS_VALUE")).alias("level"),
    )


def invalid_rates(rates: DataFrame) -> DataFrame:
    return rates.filter(
        F.col("entity").isNull() | F.col("month").isNull() | F.col("level").isNull()
    )


def load_rates(
    spark: SparkSession,
    path: str,
    dimensions: dict[str, str] = params.RATE_DIMENSIONS,
    mapping: dict[str, str] = params.AREA_TO_ENTITY,
) -> DataFrame:
    rows = read_rate_rows(spark, path, dimensions)
    require_none(
        unexpected_dimension_values(rows, dimensions).orderBy("dimension", "value"),
        "The rate file holds other series than the configured one.",
    )
    areas = area_map(spark, mapping)
    require_none(
        unmapped_areas(rows, areas).orderBy("REF_AREA"), "An area has no entity code."
    )
    rates = to_rates(rows, areas)
    require_none(invalid_rates(rates), "The rate file has rows with invalid keys or values.")
    require_none(
        duplicate_keys(rates).orderBy("month", "entity"),
        "The rate file repeats an entity and month.",
        examples=10,
    )
    return rates
