"""Forecasts and their metrics at rest, one `run=<name>` partition per job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.operators.checks import DataCheckError
from monthloom.operators.evaluate import metrics_by_entity, metrics_overall, with_errors
from monthloom.operators.rules import Rule, check, finite, unique
from monthloom.session import cut_lineage

# fixed value: the layout of a prediction row
SCHEMA = (
    "month date, entity string, model string, actual double, prediction double, "
    "train_start date, train_end date, error double, absolute_error double, squared_error double"
)
MODEL_KEY = ("month", "entity", "model")
COMPARED = ("month", "entity", "model", "actual", "prediction")


def save_evaluation(predictions: DataFrame, folder: str, run: str) -> dict[str, str]:
    """Predictions with error columns, overall metrics and metrics by entity. The
    metrics are computed from the written rows, so the forecasts run once."""
    paths = {
        name: f"{folder.rstrip('/')}/{name}/run={run}"
        for name in ("predictions", "overall_metrics", "entity_metrics")
    }
    with_errors(predictions).write.mode("overwrite").parquet(paths["predictions"])
    rows = predictions.sparkSession.read.parquet(paths["predictions"])
    metrics_overall(rows).write.mode("overwrite").parquet(paths["overall_metrics"])
    metrics_by_entity(rows).write.mode("overwrite").parquet(paths["entity_metrics"])
    return paths


def _compared(rows: DataFrame) -> DataFrame:
    return rows.select(*COMPARED, F.col("_metadata.file_path").alias("source_file"))


def read_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all runs that `save_evaluation` left below the folder."""
    return _compared(spark.read.schema(SCHEMA).parquet(f"{folder.rstrip('/')}/predictions"))


def read_prediction_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Every `*_predictions.csv` at any depth below the folder; the five compared columns
    are taken by header name, whatever else a file holds and in whatever order. A file
    without one of them, or a cell that does not parse, is an error. Files are one per
    model run; only their headers are looked at one by one."""
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*_predictions.csv")
        .load(folder)
    )
    paths = sorted(r.path for r in listing.select("path").collect())
    kinds = dict(part.split(" ") for part in SCHEMA.split(", "))
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        header = tuple(spark.read.option("header", "true").csv(path).columns)
        by_header.setdefault(header, []).append(path)
    rows = spark.createDataFrame([], SCHEMA + ", source_file string").select(*COMPARED, "source_file")
    for header, same in sorted(by_header.items()):
        missing = sorted(set(COMPARED) - set(header))
        if missing:
            raise DataCheckError(f"Prediction files lack the columns {missing}: {same[:10]}.")
        schema = ", ".join(f"`{c}` {kinds[c] if c in COMPARED else 'string'}" for c in header)
        read = (
            spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").csv(same)
        )
        rows = rows.unionByName(_compared(read))
    return rows


def prediction_rules() -> list[Rule]:
    return [
        finite(
            "not_finite",
            "Prediction files hold missing or non-finite values.",
            ["actual", "prediction"],
            ("source_file", "entity", "month"),
        ),
        unique("A model has two predictions for an entity and month.", MODEL_KEY),
    ]


def checked_predictions(rows: DataFrame) -> DataFrame:
    """The rows, read once and checked in one job."""
    rows = cut_lineage(rows)
    if not check(rows, prediction_rules(), {"n": F.count(F.lit(1))}, MODEL_KEY)["n"]:
        raise DataCheckError("There are no prediction rows.")
    return rows


def load_predictions(
    spark: SparkSession, folder: str, csv_folder: str | None = None
) -> DataFrame:
    """Rows of the jobs' own files and, if a folder is given, of CSV files from elsewhere."""
    rows = read_predictions(spark, folder)
    if csv_folder is not None:
        rows = rows.unionByName(read_prediction_csv(spark, csv_folder))
    return checked_predictions(rows)
