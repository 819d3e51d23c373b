"""Raw series files `<id>_<CC>_m_<period>.csv` into one long table.

The file listing is filtered on name before any content is read: the filter on
the file metadata columns prunes the listing itself. Each file then becomes one
row, is decoded and split into lines, all inside the same narrow stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom import params
from monthloom.functions.calendar import month_text, parse_month
from monthloom.functions.text import base_name, decode_text, parse_series_value
from monthloom.operators.checks import require_none, require_rows
from monthloom.session import cut_lineage

# fixed value: the file-name format
NAME_PATTERN = r"(?i)^(\d+)_([A-Z]{2})_m_[^.]+\.csv$"
PREAMBLE_LINES = 2


def feature_name(series_id: Column, catalogue_name: Column) -> Column:
    """The catalogue's name, else a name made from the id and its range."""
    prefix = F.when(
        series_id.cast("bigint") >= params.FIRST_TOPIC_ID, F.lit("t_")
    ).otherwise(F.lit("cat_"))
    return F.coalesce(catalogue_name, F.concat(prefix, series_id))


def feature_kind(feature: Column) -> Column:
    return F.when(feature.startswith("t_"), F.lit("topic")).otherwise(F.lit("category"))


def exclusion_label(
    series_id: Column, entity: Column, series: Sequence[str], entities: Sequence[str]
) -> Column:
    """`series` before `entity`, so that each file is counted once; NULL = retained."""
    return F.when(series_id.isin(*series), F.lit("series")).when(
        entity.isin(*entities), F.lit("entity")
    )


def with_names(files: DataFrame, catalogue: DataFrame | None) -> DataFrame:
    """Add `feature` and `kind` to rows that have a `series_id`.

    `catalogue` has (series_id, name) with unique ids. It is joined without a hint:
    adaptive execution broadcasts it when its measured size allows.
    """
    if catalogue is None:
        named = files.withColumn("name", F.lit(None).cast("string"))
    else:
        named = files.join(catalogue.select("series_id", "name"), "series_id", "left")
    return (
        named.withColumn("feature", feature_name(F.col("series_id"), F.col("name")))
        .withColumn("kind", feature_kind(F.col("feature")))
        .drop("name")
    )


def excluded_counts(labelled: DataFrame) -> DataFrame:
    """Number of excluded files by rule and code."""
    code = F.when(F.col("label") == "series", F.col("series_id")).otherwise(F.col("entity"))
    return (
        labelled.filter(F.col("label").isNotNull())
        .groupBy("label", code.alias("code"))
        .agg(F.count(F.lit(1)).alias("n_files"))
    )


def duplicate_series(named: DataFrame) -> DataFrame:
    """Entity-feature pairs that more than one file maps to."""
    return (
        named.groupBy("entity", "feature")
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.min("series_id").alias("first_series_id"),
            F.max("series_id").alias("last_series_id"),
        )
        .filter("n_files > 1")
    )


def _scan(spark: SparkSession, folder: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    )


def _with_key(scan: DataFrame, series: Sequence[str], entities: Sequence[str]) -> DataFrame:
    name = base_name(F.col("_metadata.file_path"))
    series_id = F.regexp_extract(name, NAME_PATTERN, 1)
    entity = F.upper(F.regexp_extract(name, NAME_PATTERN, 2))
    return scan.filter(name.rlike(NAME_PATTERN)).withColumns(
        {
            "series_id": series_id,
            "entity": entity,
            "label": exclusion_label(series_id, entity, series, entities),
        }
    )


def list_series_files(
    spark: SparkSession,
    folder: str,
    excluded_series: Sequence[str] = params.EXCLUDED_SERIES,
    excluded_entities: Sequence[str] = params.EXCLUDED_ENTITIES,
) -> DataFrame:
    """(path, series_id, entity, label) of every monthly file; no content is read."""
    return _listed(keyed_files(spark, folder, excluded_series, excluded_entities))


def keyed_files(
    spark: SparkSession,
    folder: str,
    excluded_series: Sequence[str] = params.EXCLUDED_SERIES,
    excluded_entities: Sequence[str] = params.EXCLUDED_ENTITIES,
) -> DataFrame:
    """The one listing of a folder that keys, checks and contents are taken from."""
    return _with_key(_scan(spark, folder), excluded_series, excluded_entities)


def _listed(keyed: DataFrame) -> DataFrame:
    return keyed.select(
        F.col("_metadata.file_path").alias("path"), "series_id", "entity", "label"
    )


def parse_files(files: DataFrame, keep: Sequence[str] = ("path",)) -> DataFrame:
    """From rows with `content` (bytes of a series file): one row per data line with the
    columns in `keep`, `month` and `value`; bad cells are NULL. A file whose every line is
    missing keeps one row, so that it can be reported."""
    lines = files.select(
        *keep,
        F.posexplode(F.split(decode_text(F.col("content")), r"\r\n|\r|\n")).alias("pos", "line"),
    )
    cells = F.from_csv(F.col("line"), F.lit("m string, v string"))
    body = F.col("pos") >= PREAMBLE_LINES
    return lines.withColumn("c", F.when(body, cells)).select(
        *keep,
        parse_month(F.col("c.m")).alias("month"),
        parse_series_value(F.col("c.v")).alias("value"),
    )


def parse_lines(keyed: DataFrame) -> DataFrame:
    """Data lines of the retained files of a listing with keys."""
    retained = keyed.filter(F.col("label").isNull()).select(
        F.col("_metadata.file_path").alias("path"), "series_id", "entity", "content"
    )
    return parse_files(retained, ["path", "series_id", "entity"])


def usable(lines: DataFrame) -> DataFrame:
    return lines.dropna(subset=["month", "value"])


def files_without_rows(lines: DataFrame) -> DataFrame:
    good = F.col("month").isNotNull() & F.col("value").isNotNull()
    return (
        lines.groupBy("path")
        .agg(F.count_if(good).alias("n_usable"))
        .filter("n_usable = 0")
    )


def duplicate_months(lines: DataFrame) -> DataFrame:
    return (
        usable(lines)
        .groupBy("path", month_text(F.col("month")).alias("month"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )


def read_series(
    spark: SparkSession,
    folder: str,
    catalogue: DataFrame | None = None,
    excluded_series: Sequence[str] = params.EXCLUDED_SERIES,
    excluded_entities: Sequence[str] = params.EXCLUDED_ENTITIES,
    check: bool = True,
) -> DataFrame:
    """Every retained file as rows (entity, feature, kind, month, value)."""
    keyed = keyed_files(spark, folder, excluded_series, excluded_entities)
    if check:
        files = _listed(keyed)
        require_rows(files, f"No monthly series files under {folder}.")
        retained = files.filter(F.col("label").isNull())
        require_rows(retained, "No series files remain after the exclusions.")
        require_none(
            duplicate_series(with_names(retained, catalogue)).orderBy("entity", "feature"),
            "More than one file maps to the same entity and feature.",
            examples=10,
        )
    lines = parse_lines(keyed)
    if check:
        # two checks and the caller read the lines; the files are opened once
        lines = cut_lineage(lines)
        require_none(files_without_rows(lines), "A series file has no usable row.")
        require_none(
            duplicate_months(lines).orderBy("path", "month"),
            "A series file repeats a month.",
        )
    return with_names(usable(lines), catalogue).select(
        "entity", "feature", "kind", "month", "value"
    )


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The (series_id, name) catalogue from a CSV file with a header."""
    catalogue = (
        spark.read.schema("series_id string, name string").option("header", "true").csv(path)
    )
    require_none(
        catalogue.groupBy("series_id").count().filter("count > 1"),
        "The catalogue repeats a series id.",
    )
    return catalogue
