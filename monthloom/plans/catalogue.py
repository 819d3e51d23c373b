"""The registered queries: each composes operators over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.functions.numeric import round_half_up
from monthloom.operators import (
    boosting,
    breaks,
    checks,
    compare,
    coverage,
    detrend,
    evaluate,
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
from monthloom.operators.series import SERIES
from monthloom.plans import inputs
from monthloom.session import cut_lineage, scratch_path
from monthloom.sources import panel_store, prediction_files, rate_file, series_files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

GRID_STARTUP, GRID_WARMUP = 3, 3
SHORT_AR = "AR(target lag 2)"


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: round_half_up(F.col(c), p) for c, p in places.items()})


def big(col: str) -> Column:
    return F.col(col).cast("bigint").alias(col)


# --------------------------------------------------------------- series files


@query
def series_label_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = series_files.exclusion_label(
        F.col("series_id"), F.col("entity"), inputs.EXCLUDED_SERIES, inputs.EXCLUDED_ENTITIES
    )
    labelled = cut_lineage(inputs.files(spark, sf_dir).withColumn("label", label))
    kept = series_files.with_names(
        labelled.filter(F.col("label").isNull()), inputs.catalogue(spark, sf_dir)
    )
    retained = kept.groupBy(F.lit("retained").alias("label"), F.col("feature").alias("code")).agg(
        F.count(F.lit(1)).alias("n_files")
    )
    return series_files.excluded_counts(labelled).unionByName(retained)


@query
def duplicate_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = series_files.with_names(inputs.files(spark, sf_dir), inputs.catalogue(spark, sf_dir))
    return series_files.duplicate_series(named)


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_files.parse_files(inputs.series_contents(spark, sf_dir))


@query
def parsed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_files.usable(_parsed(spark, sf_dir))


@query
def files_without_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_files.files_without_rows(_parsed(spark, sf_dir))


@query
def duplicate_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_files.duplicate_months(_parsed(spark, sf_dir))


# --------------------------------------------------------- calendar, coverage


@query
def calendar_skeleton_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.calendar_gaps(inputs.feature_series(spark, sf_dir, "nation", by_brand=True))


@query
def missing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.top_missing(inputs.feature_series(spark, sf_dir, "nation", by_brand=True))


@query
def missing_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.missing_counts(inputs.feature_series(spark, sf_dir, "nation", by_brand=True))


@query
def feature_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.feature_coverage(inputs.brand_series(spark, sf_dir))


@query
def feature_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.feature_gaps(inputs.brand_series(spark, sf_dir))


# --------------------------------------------------------------------- breaks


@query
def break_window_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = breaks.break_window_means(inputs.feature_series(spark, sf_dir), inputs.BREAKS)
    return rounded(means, mean_before=6, mean_after=6, raw_ratio=8)


def _adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breaks.adjust_breaks(inputs.filled_series(spark, sf_dir), inputs.BREAKS)


def _staged_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend removal reads its input three times, so it is written once."""
    return cut_lineage(_adjusted(spark, sf_dir))


@query
def break_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.unpack(_adjusted(spark, sf_dir)), value=4)


# -------------------------------------------------------------- trend removal


@query
def shift_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series rescaled to lie around zero, so that most of them need the shift."""
    long = inputs.feature_series(spark, sf_dir, "nation").withColumn(
        "value", F.col("value") / 1e5 - 2.0
    )
    return rounded(series.unpack(detrend.shift_to_positive(series.pack(long))), value=8)


@query
def constant_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature is held constant to show both outcomes."""
    value = F.when(F.col("feature") == "PROMO", F.lit(7.0)).otherwise(F.col("value"))
    long = inputs.feature_series(spark, sf_dir, "nation").withColumn("value", value)
    flagged = detrend.flag_varying(series.pack(long))
    return flagged.select(*SERIES, F.size("values").cast("bigint").alias("n_months"), "varying")


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detrend.flag_varying(detrend.shift_to_positive(_adjusted(spark, sf_dir)))


@query
def hp_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    trended = detrend.with_trend(_shifted(spark, sf_dir))
    return rounded(series.unpack(trended, "logs", "trend"), logs=8, trend=7)


@query
def trend_standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.unpack(detrend.with_trend(_shifted(spark, sf_dir)), "score"), score=5)


@query
def pc1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = detrend.flag_varying(detrend.shift_to_positive(_staged_adjusted(spark, sf_dir)))
    trend = detrend.common_trend(shifted)
    months = coverage.calendar_array(series.unpack(shifted))
    cells = F.arrays_zip(months.alias("month"), "pc1", "pc1_rescaled")
    rows = trend.select("entity", F.inline(cells).alias("month", "pc1", "pc1_rescaled"))
    return rounded(rows, pc1=5, pc1_rescaled=6)


def _detrended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detrend.detrend(_staged_adjusted(spark, sf_dir))


@query
def detrended(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.unpack(_detrended(spark, sf_dir)).withColumn("value", F.col("value") / 1e6)
    return rounded(rows, value=6)


# ---------------------------------------------------------- transforms, panel


@query
def log_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the adjusted series divided by a million."""
    packed = _adjusted(spark, sf_dir).withColumn(
        "values", F.transform("values", lambda v: v / 1e6)
    )
    return rounded(series.unpack(transforms.log_transforms(packed)), value=8)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.unpack(transforms.log_transforms(_detrended(spark, sf_dir)))


PANEL_FEATURES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.balanced_panel(
        _features(spark, sf_dir), PANEL_FEATURES, REGIONS, inputs.REFERENCE_REGION
    )


def _panel_columns(df: DataFrame, **more: int) -> DataFrame:
    out = rounded(df, **{f: 5 for f in PANEL_FEATURES}, **more)
    return out.withColumns(
        {c: F.col(f"`{c}`").cast("bigint") for c in df.columns if c.startswith(panel.DUMMY_PREFIX)}
    )


@query
def balanced_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel_columns(_panel(spark, sf_dir))


@query
def incomplete_panel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a panel of the nation series loses, by way of the yearly change."""
    long = inputs.feature_series(spark, sf_dir, "nation")
    changed = series.unpack(transforms.log_transforms(series.pack(long)))
    return panel.incomplete_rows(changed, len(PANEL_FEATURES))


def _modelling_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = target.attach_rates(
        _panel(spark, sf_dir), inputs.rates(spark, sf_dir), check=False
    )
    return target.with_target(target.add_change(target.fill_isolated_gaps(joined)))


@query
def modelling_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel_columns(_modelling_panel(spark, sf_dir), level_lag1=7, target=7)


@query
def panel_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel written, loaded with its checks, and read back."""
    path = scratch_path(spark, "panel")
    panel_store.write_panel(_modelling_panel(spark, sf_dir), path)
    rows, _ = panel_store.load_panel(spark, path)
    return _panel_columns(rows, level_lag1=7, target=7)


@query
def panel_level_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "panel")
    panel_store.write_panel(_modelling_panel(spark, sf_dir), path)
    return rounded(panel_store.level_keys(spark, path), level_lag1=7, target=7)


@query
def panel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = panel.panel_summary(
        _modelling_panel(spark, sf_dir), PANEL_FEATURES, target=target.TARGET
    )
    return rounded(summary, target_min=7, target_max=7)


def _faulty_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modelling panel with faults of every kind, by calendar month and region."""
    rows = _modelling_panel(spark, sf_dir)
    at = lambda entity, month: (F.col("entity") == entity) & (F.month("month") == month)
    rows = rows.unionByName(rows.where(at("AMERICA", 12))).withColumns(
        {
            "ECONOMY": F.when(at("ASIA", 3), F.lit(float("nan"))).otherwise(F.col("ECONOMY")),
            "target": F.when(~at("EUROPE", 7), F.col("target")),
            "C_EUROPE": F.when(at("EUROPE", 5), 0).otherwise(F.col("C_EUROPE")),
        }
    )
    return rows.withColumn("month", F.when(~at("AFRICA", 9), F.col("month")))


@query
def panel_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of every rule of a combined panel, counted in one pass."""
    rows = _faulty_panel(spark, sf_dir)
    own = panel.combined_rules(rows, PANEL_FEATURES, target.TARGET, excluded=("MIDDLE EAST",))
    return rules.violations(rows, own)


@query
def model_panel_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _faulty_panel(spark, sf_dir)
    return rules.violations(rows, panel_store.model_rules(panel_store.feature_columns(rows)))


@query
def observed_panel_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a checked write of the sound panel counts on its way: rows, entities, span, target."""
    rows, path = _modelling_panel(spark, sf_dir), scratch_path(spark, "panel")
    own = panel.combined_rules(rows, PANEL_FEATURES, target.TARGET)
    seen = panel_store.write_checked(rows, path, own, panel.shape_totals(target.TARGET))
    row = (seen["_rows"], seen["n_entities"], seen["repeated_key"], seen["first_month"], seen["last_month"],
           seen["target_min"], seen["target_max"])
    schema = (
        "n_rows long, n_entities long, repeated_key long, first_month date, last_month date, "
        "target_min double, target_max double"
    )
    return rounded(spark.createDataFrame([row], schema), target_min=7, target_max=7)


def _packed_panel(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The modelling panel with features in an array, written with its dictionaries and read back."""
    long = cut_lineage(_features(spark, sf_dir))
    dictionary = cut_lineage(packed.feature_dictionary(long))
    joined = target.attach_rates(
        packed.pack_panel(long, dictionary), inputs.rates(spark, sf_dir), check=False
    )
    rows = target.with_target(target.add_change(target.fill_isolated_gaps(joined)))
    path = scratch_path(spark, "packed")
    panel_store.write_checked(
        rows, path, [rules.unique("The panel repeats an entity and month."), *packed.packed_rules(dictionary)]
    )
    entities = packed.entity_dictionary(rows, inputs.REFERENCE_REGION)
    panel_store.write_dictionaries(dictionary, entities, path)
    written, _ = panel_store.load_panel(spark, path)
    return written, *panel_store.read_dictionaries(spark, path)


@query
def packed_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed panel in long form, with the lag and the target of each row."""
    rows, dictionary, _ = _packed_panel(spark, sf_dir)
    changes = rows.select("entity", "month", "level_lag1", "target")
    long = packed.unpacked(rows, dictionary).join(changes, ["entity", "month"])
    return rounded(long, value=5, level_lag1=7, target=7)


@query
def packed_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of the design vector by name: how many rows are not zero there, and their sum."""
    rows, dictionary, entities = _packed_panel(spark, sf_dir)
    vectors = packed.design(rows, entities, ["level_lag1"])
    cells = vectors.select(F.posexplode(vector_to_array("features_vec")).alias("position", "value"))
    found = (
        cells.join(packed.design_names(dictionary, entities, ["level_lag1"]), "position")
        .groupBy("feature")
        .agg(F.count_if(F.col("value") != 0).alias("n_nonzero"), F.sum("value").alias("total"))
    )
    return rounded(found, total=4)


# ---------------------------------------------------------------------- rates


@query
def rate_dimension_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = inputs.table(spark, sf_dir, "orders")
    return checks.unexpected_dimension_values(orders, inputs.DIMENSIONS)


@query
def unmapped_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer nations that the code table does not list."""
    rows = inputs.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("REF_AREA")
    )
    areas = spark.createDataFrame(list(inputs.AREA_CODES.items()), "REF_AREA string, entity string")
    return rate_file.unmapped_areas(rows, areas)


def _parsed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = rate_file.area_map(spark, inputs.AREA_CODES)
    return rate_file.to_rates(inputs.rate_rows(spark, sf_dir), areas)


@query
def parsed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed_rates(spark, sf_dir)


@query
def invalid_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_file.invalid_rates(_parsed_rates(spark, sf_dir))


@query
def duplicate_rate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicate_keys(_parsed_rates(spark, sf_dir))


@query
def entities_without_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that never ordered."""
    customers = inputs.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("CUSTOMER_"), F.col("c_custkey").cast("string")).alias("entity")
    )
    return target.entities_without_rates(customers, inputs.rates(spark, sf_dir, "customer"))


@query
def customers_without_early_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that did not order in the first year of orders."""
    customers = inputs.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("CUSTOMER_"), F.col("c_custkey").cast("string")).alias("entity")
    )
    early = inputs.rates(spark, sf_dir, "customer").where("month < DATE'1996-01-01'")
    return target.entities_without_rates(customers, early)


def _filled_rates(spark: SparkSession, sf_dir: str, grain: str = "customer") -> DataFrame:
    rates = inputs.rates(spark, sf_dir, grain)
    joined = target.attach_rates(inputs.panel_keys(rates), rates, check=False)
    return target.fill_isolated_gaps(joined)


@query
def interpolated_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_filled_rates(spark, sf_dir), level=7)


@query
def imputed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(target.imputed_rates(_filled_rates(spark, sf_dir)), imputed_value=7)


@query
def remaining_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target.remaining_gaps(_filled_rates(spark, sf_dir))


@query
def gap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target.gap_audit(_filled_rates(spark, sf_dir))


def _changes(spark: SparkSession, sf_dir: str, grain: str = "nation") -> DataFrame:
    return target.with_target(target.add_change(_filled_rates(spark, sf_dir, grain)))


def _staged_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modelling panel is read by the month axis, the splits and every model, so it
    is written once, as a panel job would hand it to a training job."""
    return cut_lineage(_changes(spark, sf_dir))


@query
def change_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_changes(spark, sf_dir, "customer"), level_lag1=7, target=7)


# --------------------------------------------------------------- lags, splits


def _lagged(spark: SparkSession, sf_dir: str, grain: str = "nation") -> DataFrame:
    return lags.add_target_lags(_changes(spark, sf_dir, grain), max(inputs.LAGS))


@query
def target_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {lags.lag_name(k): 7 for k in range(1, max(inputs.LAGS) + 1)}
    return rounded(_lagged(spark, sf_dir, "customer").drop("level_lag1"), target=7, **names)


@query
def inconsistent_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A precomputed lag taken by row, which differs wherever it bridges a gap, and in
    one entity is off by a constant."""
    moved = F.when(F.col("entity") == "NATION_5", F.lit(0.25)).otherwise(F.lit(0.0))
    panel_rows = _lagged(spark, sf_dir).select(
        "entity",
        "month",
        "target",
        (F.coalesce("target_lag2", F.lit(0.0)) + moved).alias("target_lag2"),
    )
    return rounded(lags.inconsistent_lags(panel_rows, 3), found=7, expected=7)


@query
def rolling_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = splits.month_axis(_changes(spark, sf_dir))
    return splits.rolling_splits(axis, inputs.WINDOW).withColumn("test_idx", big("test_idx"))


def _indexed(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    axis = splits.month_axis(df)
    return splits.with_month_idx(df, axis), axis, splits.rolling_splits(axis, inputs.WINDOW)


@query
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _staged_changes(spark, sf_dir)
    indexed, _, windows = _indexed(lags.add_target_lags(changes, 2))
    rows = splits.split_rows(
        indexed.select("month_idx", "month", "entity", "target", "target_lag2"),
        windows,
        inputs.WINDOW,
        ["target", "target_lag2"],
    )
    return rounded(rows, target=7, target_lag2=7).withColumn("test_idx", big("test_idx"))


# ------------------------------------------------------------------ forecasts


@query
def random_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed, _, windows = _indexed(_staged_changes(spark, sf_dir))
    return rounded(forecast.random_walk(indexed, windows), actual=7, prediction=7)


@query
def pooled_ar1(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed, _, windows = _indexed(_staged_changes(spark, sf_dir))
    fits = forecast.pooled_ar_fits(
        indexed, windows, inputs.WINDOW, reference=inputs.REFERENCE_NATION
    ).select(
        "month",
        "entity",
        F.col("y").alias("actual"),
        "prediction",
        "slope",
        "rank_deficient",
        "train_start",
        "train_end",
    )
    return rounded(fits, actual=7, prediction=7, slope=7)


def _predictions(changes: DataFrame) -> DataFrame:
    """Three models' forecasts; the one on the second target lag covers fewer keys."""
    indexed, _, windows = _indexed(lags.add_target_lags(changes, 2))
    walk = forecast.random_walk(indexed, windows)
    models = {forecast.POOLED_AR: target.LEVEL_LAG, SHORT_AR: lags.lag_name(2)}
    for name, regressor in models.items():
        walk = walk.unionByName(
            forecast.pooled_ar(
                indexed, windows, inputs.WINDOW, regressor, name,
                reference=inputs.REFERENCE_NATION,
            )
        )
    return walk


@query
def error_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.with_errors(_predictions(_staged_changes(spark, sf_dir))).drop("train_start", "train_end")
    return rounded(
        rows, actual=7, prediction=7, error=7, absolute_error=7, squared_error=7
    )


@query
def metrics_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = _predictions(_staged_changes(spark, sf_dir))
    return rounded(evaluate.metrics_overall(predictions), mae=8, rmse=8, r2=8)


@query
def metrics_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = _predictions(_staged_changes(spark, sf_dir))
    return rounded(evaluate.metrics_by_entity(predictions), mae=8, rmse=8, r2=8)


@query
def metrics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall and by entity in one pass."""
    both = evaluate.metrics_all(_predictions(_staged_changes(spark, sf_dir)))
    return rounded(both.withColumn("overall", big("overall")), mae=8, rmse=8, r2=8)


@query
def predictions_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluated forecasts written by run, loaded from all runs with their checks."""
    folder = scratch_path(spark, "evaluation")
    predictions = cut_lineage(_predictions(_staged_changes(spark, sf_dir)))
    for run, model in (("walk", forecast.RANDOM_WALK), ("ar", forecast.POOLED_AR), ("ar2", SHORT_AR)):
        prediction_files.save_evaluation(predictions.filter(F.col("model") == model), folder, run)
    rows = prediction_files.load_predictions(spark, folder).drop("source_file")
    return rounded(rows, actual=7, prediction=7)


# ----------------------------------------------------------------- comparison


def _staged_predictions(changes: DataFrame) -> DataFrame:
    """Written once, as forecasting jobs leave prediction files for the comparison."""
    return cut_lineage(_predictions(changes))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _staged_changes(spark, sf_dir)
    return compare.attach_levels(
        compare.common_sample(_staged_predictions(changes)), changes
    )


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.ranking(compare.level_metrics(_levels(spark, sf_dir)))


@query
def common_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compare.common_sample(_staged_predictions(_staged_changes(spark, sf_dir)))
    return rounded(rows.drop("train_start", "train_end"), actual=7, prediction=7)


@query
def widest_forecast_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key on which the models disagree most."""
    rows = compare.common_sample(_staged_predictions(_staged_changes(spark, sf_dir)))
    return rounded(compare.widest_spread(rows, "prediction"), spread=7)


@query
def sample_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per model before and after the restriction to common keys."""
    predictions = _staged_predictions(_staged_changes(spark, sf_dir))
    before = compare.rows_per_model(predictions).withColumnRenamed("n", "n_before")
    after = compare.rows_per_model(compare.common_sample(predictions))
    return before.join(after.withColumnRenamed("n", "n_common"), "model", "left")


@query
def level_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the rules of reconstructed levels, against a panel with faults."""
    changes = _staged_changes(spark, sf_dir)
    june = F.month("month") == 6
    faulty = changes.where("entity <> 'NATION_4'").withColumns(
        {
            "target": F.col("target") + F.when(june, 0.5).otherwise(0.0),
            "level_lag1": F.when(F.col("entity") == "NATION_2", -100.0).otherwise(F.col("level_lag1")),
        }
    )
    common = compare.common_sample(_staged_predictions(changes))
    return rules.violations(compare.attach_levels(common, faulty), compare.level_rules())


@query
def level_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.level_metrics(_levels(spark, sf_dir)), rmse=8, mae=8, mape=8)


@query
def model_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ranked(spark, sf_dir), rmse=8, mae=8, mape=8)


@query
def prediction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = compare.prediction_audit(_levels(spark, sf_dir))
    values = [c for c in audit.columns if c not in ("month", "entity", "model")]
    return rounded(audit, **{c: 7 for c in values})


@query
def plot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.plot_metrics(_ranked(spark, sf_dir)), value=6)


@query
def plot_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = _levels(spark, sf_dir)
    rows = compare.plot_series(levels, ("NATION_1", "NATION_8"))
    return rounded(
        rows, actual_level=7, prediction_level=7, axis_low=6, axis_high=6
    )


# --------------------------------------------------------------------- tuning


def _design(changes: DataFrame, mode: str = "exact", **options) -> DataFrame:
    axis = splits.month_axis(changes)
    options = options or {"holdout_months": inputs.HOLDOUT}
    return splits.validation_design(
        axis, list(inputs.WINDOWS), inputs.VALIDATION, mode=mode, **options
    )


def _design_columns(design: DataFrame) -> DataFrame:
    return design.select(big("month_idx"), "month", "role", big("max_window"))


@query
def validation_design_at_or_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _staged_changes(spark, sf_dir)
    return _design_columns(_design(changes, "at_or_before", tuning_end="2000-06"))


@query
def validation_design_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _design_columns(_design(_staged_changes(spark, sf_dir)))


@query
def month_axis_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of an axis with holes that are not followed by the next calendar month."""
    kept = _staged_changes(spark, sf_dir).where((F.year("month") * 12 + F.month("month")) % 11 != 0)
    return splits.axis_gaps(splits.month_axis(kept))


@query
def rw_validation_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _staged_changes(spark, sf_dir)
    return rounded(tuning.zero_change_rmse(changes, _design(changes)), benchmark_rmse=8)


@query
def search_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    design = _design(_staged_changes(spark, sf_dir))
    trials = tuning.search_trials(
        design, 50, [*inputs.WINDOWS, 72], inputs.LAGS, tuning.LEAFWISE_SPACE
    )
    whole = ("trial", "window_months", "target_lags", "n_estimators", "max_depth",
             "num_leaves", "min_rows", "max_bin")
    out = trials.withColumns({c: big(c) for c in whole})
    return rounded(
        out, learning_rate=8, min_gain=8, subsample=8, column_fraction=8
    )


def _grid(spark: SparkSession) -> DataFrame:
    """Every window with every lag, as the trials of study 0."""
    rows = [
        (0, i * len(inputs.LAGS) + j, w, k)
        for i, w in enumerate(inputs.WINDOWS)
        for j, k in enumerate(inputs.LAGS)
    ]
    return spark.createDataFrame(
        rows, "study int, trial int, window_months int, target_lags int"
    )


def _folds(changes: DataFrame) -> DataFrame:
    indexed, _, _ = _indexed(lags.add_target_lags(changes, max(inputs.LAGS)))
    regressors = [target.LEVEL_LAG, *[lags.lag_name(k) for k in inputs.LAGS[1:]]]
    trials, design = _grid(changes.sparkSession), _design(changes)
    folds = cut_lineage(
        tuning.ar_folds(indexed, design, trials, regressors, inputs.REFERENCE_NATION)
    )
    return tuning.complete_folds(folds, trials, design)


def _states(changes: DataFrame) -> DataFrame:
    curves = tuning.running_rmse(_folds(changes))
    return tuning.median_stopping(curves, GRID_STARTUP, GRID_WARMUP)


@query
def trial_running_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = tuning.running_rmse(_folds(_staged_changes(spark, sf_dir))).select(
        big("study"), big("trial"), big("step"), "n", "sse", "running_rmse"
    )
    return rounded(curves, sse=7, running_rmse=8)


@query
def monthly_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = tuning.monthly_rmse(_folds(_staged_changes(spark, sf_dir)))
    return rounded(
        lists.select(
            big("trial"), F.posexplode("monthly_rmse").alias("step", "rmse")
        ).withColumn("step", big("step")),
        rmse=8,
    )


@query
def median_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _states(_staged_changes(spark, sf_dir)).select(
        big("study"), big("trial"), "state", big("months_evaluated"), "value"
    )
    return rounded(states, value=8)


@query
def trial_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuning.trial_counts(_states(_staged_changes(spark, sf_dir))).withColumn("study", big("study"))


@query
def best_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = tuning.best_trial(_states(_staged_changes(spark, sf_dir))).select(
        big("study"), big("trial"), big("months_evaluated"), "value"
    )
    return rounded(best, value=8)


@query
def tuned_ar_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the autoregression search, settings as plain columns."""
    changes = _staged_changes(spark, sf_dir)
    design = _design(changes)
    report = tuning.tuning_report(
        "ar1",
        _grid(spark),
        cut_lineage(_states(changes)),
        design,
        tuning.zero_change_rmse(changes, design),
        changes,
        mode="exact",
    )
    flat = report.select(
        "model",
        big("best_trial"),
        F.col("best_params.window_months").cast("bigint").alias("window_months"),
        F.col("best_params.target_lags").cast("bigint").alias("target_lags"),
        "best_rmse",
        "benchmark_rmse",
        "ratio_to_benchmark",
        "validation_start",
        "tuning_end",
        "n_validation",
        "recommended_test_start",
        "holdout_end",
        "n_holdout",
        "n_trials",
        "n_complete",
        "n_stopped",
        "panel_months",
        "panel_entities",
        "panel_rows",
    )
    return rounded(flat, best_rmse=8, benchmark_rmse=8, ratio_to_benchmark=7)


# -------------------------------------------------------------- boosted trees

# The fits take the jobs' defaults, 300 trees. Only the search below is a small one.


def _boost_data(
    spark: SparkSession, sf_dir: str, lag_counts: tuple[int, ...] = (1,)
) -> dict[int, boosting.RollingData]:
    most = max(lag_counts)
    rows = cut_lineage(lags.add_target_lags(_modelling_panel(spark, sf_dir), most))
    dummy = [c for c in rows.columns if c.startswith(panel.DUMMY_PREFIX)]
    base = [*PANEL_FEATURES, *dummy, target.LEVEL_LAG]
    staged = boosting.stage(rows, lags.model_features(base, most))
    return {k: boosting.with_features(staged, lags.model_features(base, k)) for k in lag_counts}


def _boost(spark: SparkSession, sf_dir: str, settings: boosting.BoostingSettings):
    data = _boost_data(spark, sf_dir)[1]
    last = len(data.months)
    return boosting.rolling_boosting(
        data, inputs.WINDOW, settings, test_idx=range(last - inputs.HOLDOUT, last)
    )


@query
def gbt_depthwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of the holdout months."""
    return _boost(spark, sf_dir, boosting.BoostingSettings()).predictions


@query
def gbt_leafwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boost(spark, sf_dir, boosting.leafwise_defaults()).predictions


@query
def gbt_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _boost(spark, sf_dir, boosting.BoostingSettings())
    return boosting.importance_table(result.importances)


@query
def tuned_vs_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small search over boosted trees on the validation months."""
    by_lags = _boost_data(spark, sf_dir, (0, 1))
    data = by_lags[0]
    axis = spark.createDataFrame(list(enumerate(data.months)), "month_idx int, month date")
    design = splits.validation_design(
        axis,
        [inputs.WINDOW],
        inputs.VALIDATION,
        holdout_months=inputs.HOLDOUT,
        mode="at_or_before",
    )
    validation = [
        r.month_idx for r in design.filter("role = 'validation'").orderBy("month_idx").collect()
    ]
    space = (
        tuning.IntRange("max_depth", 2, 3),
        tuning.FloatRange("learning_rate", 0.05, 0.2, log=True),
    )
    trials = tuning.search_trials(design, 3, [12, inputs.WINDOW], [0, 1], space).withColumn(
        "study", F.lit(0)
    )
    folds = tuning.tune_boosting(
        by_lags,
        validation,
        [r.asDict() for r in trials.orderBy("trial").collect()],
        lambda t: boosting.BoostingSettings(
            n_estimators=3,
            learning_rate=t["learning_rate"],
            max_depth=t["max_depth"],
            min_rows=5,
        ),
        startup_trials=1,
        warmup_months=2,
    )
    states = tuning.median_stopping(tuning.running_rmse(folds), 1, 2)
    return tuning.tuning_report(
        "depthwise", trials, states, design,
        tuning.zero_change_rmse(data.rows, design), data.rows,
    )
