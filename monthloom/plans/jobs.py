"""The four jobs end to end: build the panel, forecast, tune, compare.

Each job reads what the one before it wrote; the folders are the only hand-over.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom import params
from monthloom.functions.calendar import month_setting
from monthloom.operators import (
    boosting,
    breaks,
    compare,
    coverage,
    detrend,
    forecast,
    lags,
    packed,
    panel,
    rules,
    series,
    splits,
    target,
    transforms,
    tuning,
)
from monthloom.operators.checks import DataCheckError, duplicate_keys, require_none
from monthloom.params import BreakRule
from monthloom.session import cut_lineage
from monthloom.sources import artifacts, panel_store, prediction_files, rate_file, series_files


def build_panel(
    spark: SparkSession,
    series_folder: str,
    rate_path: str,
    out_path: str,
    catalogue: DataFrame | None = None,
    rule: BreakRule = BreakRule(),
    reference: str = params.REFERENCE_ENTITY,
    orient: str = "loading",
) -> DataFrame:
    """Series files and rate file to the modelling panel; returns the run summary."""
    labelled = cut_lineage(series_files.list_series_files(spark, series_folder))
    features_long = _transformed(spark, series_folder, catalogue, rule, orient)
    built, features = panel.build_panel(features_long, reference)
    # the rules ride on the writes; no job looks at the rows again unless one is broken
    counted = rules.watched(built, panel.panel_rules(built, features), panel.shape_totals())
    built = cut_lineage(counted.frame)
    panel.require_dummies(built, counted.require(built)["n_entities"])
    filled = cut_lineage(
        target.fill_isolated_gaps(target.attach_rates(built, rate_file.load_rates(spark, rate_path)))
    )
    combined = target.with_target(target.add_change(filled))
    totals = panel_store.write_checked(
        combined,
        out_path,
        panel.combined_rules(combined, features, target.TARGET),
        panel.shape_totals(target.TARGET),
    )
    written = spark.read.parquet(out_path)
    panel.require_dummies(written, totals["n_entities"])
    return run_summary(labelled, features_long, features, filled, written)


def _transformed(
    spark: SparkSession, series_folder: str, catalogue: DataFrame | None, rule: BreakRule, orient: str
) -> DataFrame:
    """Series files to the long table of transformed features."""
    long = series_files.read_series(spark, series_folder, catalogue)
    adjusted = cut_lineage(breaks.adjust_breaks(long, rule))
    # a break adjustment leaves calendars as they are
    coverage.require_complete_calendar(long)
    return cut_lineage(
        series.unpack(transforms.log_transforms(detrend.detrend(adjusted, orient=orient)))
    )


def build_packed_panel(
    spark: SparkSession,
    series_folder: str,
    rate_path: str,
    out_path: str,
    catalogue: DataFrame | None = None,
    rule: BreakRule = BreakRule(),
    reference: str = params.REFERENCE_ENTITY,
    orient: str = "loading",
) -> DataFrame:
    """The panel with all features of a row in one array, for any number of features; returns
    its shape. The other jobs read it as they read a wide one."""
    features_long = _transformed(spark, series_folder, catalogue, rule, orient)
    coverage.require_equal_coverage(features_long)
    dictionary = cut_lineage(packed.feature_dictionary(features_long))
    own = packed.packed_rules(dictionary, params.EXCLUDED_ENTITIES)
    counted = rules.watched(packed.pack_panel(features_long, dictionary), own)
    built = cut_lineage(counted.frame)
    if not counted.require(built)["_rows"]:
        raise DataCheckError("No complete entity-month remains after the transforms.")
    rates = rate_file.load_rates(spark, rate_path)
    combined = target.with_target(
        target.add_change(target.fill_isolated_gaps(target.attach_rates(built, rates)))
    )
    whole = [target.LEVEL_LAG, target.TARGET]
    totals = panel_store.write_checked(
        combined,
        out_path,
        [
            rules.unique("The panel repeats an entity and month."),
            *own,
            rules.finite("target_not_finite", "The combined panel has missing or non-finite values.", whole),
        ],
        panel.shape_totals(target.TARGET),
    )
    written = spark.read.schema(combined.schema).parquet(out_path)
    panel_store.write_dictionaries(dictionary, packed.entity_dictionary(written, reference), out_path)
    shape = dictionary.agg(F.count(F.lit(1)).alias("n_features"))
    return shape.withColumns(
        {
            "n_entities": F.lit(totals["n_entities"]),
            "n_rows": F.lit(totals["_rows"]),
            "first_month": F.lit(totals["first_month"]),
            "last_month": F.lit(totals["last_month"]),
            "target_min": F.lit(totals["target_min"]),
            "target_max": F.lit(totals["target_max"]),
        }
    )


def run_summary(
    labelled: DataFrame,
    features_long: DataFrame,
    features: Sequence[str],
    filled: DataFrame,
    combined: DataFrame,
) -> DataFrame:
    """One row: files found and excluded, rows lost at each step, shape and ranges, and
    the first ten filled gaps."""
    excluded = F.count_if(F.col("label").isNotNull())
    found = labelled.agg(F.count(F.lit(1)).alias("n_files"), excluded.alias("n_excluded"))
    codes = series_files.excluded_counts(labelled).agg(
        F.array_sort(F.collect_list(F.struct("label", "code", "n_files"))).alias("excluded")
    )
    gaps = filled.agg(
        F.count_if("imputed").alias("n_filled"),
        F.count_if(F.col(target.LEVEL).isNull()).alias("n_unfilled"),
        F.count(F.lit(1)).alias("n_panel_rows"),
    )
    examples = (
        target.imputed_rates(filled)
        .orderBy("entity", "month")
        .limit(10)
        .agg(
            F.array_sort(F.collect_list(F.struct("entity", "month", "imputed_value"))).alias(
                "filled_examples"
            )
        )
    )
    shape = panel.panel_summary(combined, features, target.TARGET)

    def only(df: DataFrame):
        return df.select(F.struct("*").alias("s")).scalar()

    lost = panel.incomplete_rows(features_long, len(features))
    parts = {
        "files": only(found),
        "codes": only(codes),
        "lost": only(lost),
        "gaps": only(gaps),
        "examples": only(examples),
    }
    return (
        shape.withColumns(parts)
        .select(
            "files.*", "codes.*", "lost.*", "gaps.*", "examples.*", *shape.columns,
            (F.col("gaps.n_panel_rows") - F.col("n_rows")).alias("rows_without_target"),
        )
    )


def _test_start(text: str | None):
    return None if text is None else month_setting(text)


def forecast_baselines(
    spark: SparkSession,
    panel_path: str,
    out_folder: str,
    window: int = params.TRAINING_WINDOW,
    test_start: str | None = None,
    reference: str = params.REFERENCE_ENTITY,
) -> dict[str, str]:
    """Random walk and pooled autoregression; returns the written paths."""
    rows, _ = panel_store.load_panel(spark, panel_path)
    axis = splits.month_axis(rows)
    windows = splits.rolling_splits(axis, window, _test_start(test_start))
    splits.require_splits(windows)
    indexed = splits.with_month_idx(rows, axis)
    forecasts = forecast.random_walk(indexed, windows).unionByName(
        forecast.pooled_ar(indexed, windows, window, reference=reference)
    )
    return prediction_files.save_evaluation(forecasts, out_folder, "baseline")


def forecast_boosting(
    spark: SparkSession,
    panel_path: str,
    out_folder: str,
    settings: boosting.BoostingSettings,
    run: str,
    window: int = params.TRAINING_WINDOW,
    lag_count: int = params.TARGET_LAGS,
    test_start: str | None = None,
    parallel_fits: int | None = None,
) -> dict[str, str]:
    """Rolling boosted trees; writes forecasts, metrics, importances and last model. Finished
    splits are kept below `fits` of the out folder: a run that was stopped goes on from them."""
    rows, features = panel_store.load_panel(spark, panel_path)
    axis = splits.month_axis(rows)
    lagged = lags.add_target_lags(rows, lag_count)
    if packed.is_packed(rows):
        more = [target.LEVEL_LAG, *(lags.lag_name(k) for k in range(1, lag_count + 1))]
        data = boosting.prepare_packed(
            lagged, *panel_store.read_dictionaries(spark, panel_path), more, axis=axis
        )
    else:
        names = lags.model_features(lags.without_target_lags(features), lag_count)
        data = boosting.prepare(lagged, names, axis=axis)
    windows = splits.rolling_splits(axis, window, _test_start(test_start))
    tests = [r.test_idx for r in windows.select("test_idx").orderBy("test_idx").collect()]
    result = boosting.rolling_boosting(
        data, window, settings, tests, parallel_fits, f"{out_folder.rstrip('/')}/fits"
    )
    paths = prediction_files.save_evaluation(result.predictions, out_folder, run)
    table = boosting.importance_table(result.importances)
    paths["importance"] = artifacts.write_importance(table, out_folder, run)
    paths["model"] = artifacts.write_last_model(result.last_model, out_folder, run)
    return paths


def tune_boosting(
    spark: SparkSession,
    panel_path: str,
    out_folder: str,
    run: str,
    space: Sequence,
    settings: Callable[[dict], boosting.BoostingSettings],
    n_trials: int,
    mode: str,
    windows: Sequence[int] = params.WINDOW_OPTIONS,
    lag_options: Sequence[int] = params.LAG_OPTIONS,
    validation_months: int = params.VALIDATION_MONTHS,
    holdout_months: int | None = None,
    tuning_end: str | None = None,
    seed: int = params.SEED,
    startup_trials: int = params.STARTUP_TRIALS,
    warmup_months: int = params.WARMUP_MONTHS,
    parallel_fits: int = 4,
) -> dict[str, str]:
    """Random search on the months before the holdout; returns the written paths."""
    rows, features = panel_store.load_panel(spark, panel_path)
    axis = cut_lineage(splits.month_axis(rows))
    design = splits.validation_design(
        axis, list(windows), validation_months, holdout_months, tuning_end, mode
    )
    base = lags.without_target_lags(features)
    most = max(lag_options)
    staged = boosting.stage(
        lags.add_target_lags(rows, most), lags.model_features(base, most), axis=axis
    )
    data = {
        k: boosting.with_features(staged, lags.model_features(base, k)) for k in set(lag_options)
    }
    trials = cut_lineage(
        tuning.search_trials(design, n_trials, windows, lag_options, space, seed).withColumn(
            "study", F.lit(0)
        )
    )
    months = design.filter("role = 'validation'").orderBy("month_idx")
    folds = tuning.tune_boosting(
        data,
        [r.month_idx for r in months.collect()],
        [r.asDict() for r in trials.orderBy("trial").collect()],
        settings,
        startup_trials,
        warmup_months,
        parallel_fits,
    )
    states = tuning.median_stopping(tuning.running_rmse(folds), startup_trials, warmup_months)
    report = tuning.tuning_report(
        run, trials, states, design, tuning.zero_change_rmse(rows, design), rows, seed, mode
    )
    record = {
        "n_base_features": len(base),
        "window_options": list(windows),
        "lag_options": list(lag_options),
        "feasible_windows": splits.feasible_windows(design, list(windows)),
        "startup_trials": startup_trials,
        "warmup_months": warmup_months,
        "boundary": mode,
    }
    return artifacts.write_tuning(report, trials, states, out_folder, run, folds, record)


def compare_models(
    spark: SparkSession,
    predictions_folder: str,
    panel_path: str,
    out_folder: str,
    csv_folder: str | None = None,
    plot_entities: Sequence[str] = (),
) -> dict[str, str]:
    """Common sample, level metrics and rank of all runs, with the chart tables of the
    metrics and of the given entities; returns the written paths."""
    rows = prediction_files.load_predictions(spark, predictions_folder, csv_folder)
    common = cut_lineage(compare.checked_common_sample(rows))
    keys = panel_store.level_keys(spark, panel_path)
    require_none(duplicate_keys(keys), "The panel repeats an entity and month.")
    counted = rules.watched(compare.attach_levels(common, keys), compare.level_rules())
    levels = cut_lineage(counted.frame)
    counted.require(levels)
    if plot_entities:
        compare.check_plot_series(levels, plot_entities)
    return artifacts.write_comparison(
        levels, compare.ranking(compare.level_metrics(levels)), out_folder, plot_entities
    )
