"""Models, importances, tuning results and comparison tables at rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.operators.compare import plot_metrics, plot_series, prediction_audit
from monthloom.operators.tuning import monthly_rmse


def write_importance(table: DataFrame, folder: str, prefix: str) -> str:
    path = f"{folder.rstrip('/')}/{prefix}_feature_importance.parquet"
    table.write.mode("overwrite").parquet(path)
    return path


def write_last_model(model: PipelineModel, folder: str, prefix: str) -> str:
    path = f"{folder.rstrip('/')}/{prefix}_last_window"
    model.write().overwrite().save(path)
    return path


def read_last_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_tuning(
    report: DataFrame,
    trials: DataFrame,
    states: DataFrame,
    folder: str,
    prefix: str,
    folds: DataFrame | None = None,
    record: dict | None = None,
) -> dict[str, str]:
    """The nested one-row result as JSON and the trial history as Parquet. With `folds` the
    history has the predictions and the monthly errors of every trial, and the result the
    predictions of the best one; `record` adds the options of the search."""
    base = f"{folder.rstrip('/')}/{prefix}"
    paths = {"result": f"{base}_best.json", "trials": f"{base}_trials.parquet"}
    history = trials.join(states, ["study", "trial"], "left")
    if folds is not None:
        sizes = folds.groupBy("study", "trial").agg(F.sum("n").alias("n_predictions"))
        history = history.join(sizes, ["study", "trial"], "left").join(
            monthly_rmse(folds), ["study", "trial"], "left"
        )
        best = sizes.select(F.col("trial").alias("best_trial"), "n_predictions")
        report = report.join(best, "best_trial", "left")
    for name, value in (record or {}).items():
        many = isinstance(value, (list, tuple))
        report = report.withColumn(name, F.array(*map(F.lit, value)) if many else F.lit(value))
    report.withColumn("created_utc", F.current_timestamp()).write.mode("overwrite").json(
        paths["result"]
    )
    history.write.mode("overwrite").parquet(paths["trials"])
    return paths


def read_tuning(spark: SparkSession, path: str, report_schema) -> DataFrame:
    return spark.read.schema(report_schema).json(path)


def write_comparison(
    levels: DataFrame, ranked: DataFrame, folder: str, plot_entities: Sequence[str] = ()
) -> dict[str, str]:
    """Comparison table, prediction audit in rank order, and the tables behind the charts."""
    base = folder.rstrip("/")
    names = ["comparison", "audit", "plot_metrics", *(["plot_series"] if plot_entities else [])]
    paths = {name: f"{base}/{name}.parquet" for name in names}
    ranked.write.mode("overwrite").parquet(paths["comparison"])
    table = ranked.sparkSession.read.parquet(paths["comparison"])
    prediction_audit(levels, table).write.mode("overwrite").parquet(paths["audit"])
    plot_metrics(table).write.mode("overwrite").parquet(paths["plot_metrics"])
    if plot_entities:
        plot_series(levels, plot_entities).write.mode("overwrite").parquet(paths["plot_series"])
    return paths
