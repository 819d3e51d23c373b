"""Seeded random search over rolling validation months with median stopping."""

from __future__ import annotations

import math
import statistics
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from monthloom import params
from monthloom.functions.calendar import day_text, month_end, month_text, next_month_end
from monthloom.functions.numeric import ratio
from monthloom.operators.boosting import BoostingSettings, RollingData, fit_split, predict_split
from monthloom.operators.checks import DataCheckError
from monthloom.operators.forecast import fixed_effect_forecasts, rolling_moments
from monthloom.operators.target import TARGET

HEX_DIGITS = 13


# ---------------------------------------------------------------- search space


@dataclass(frozen=True)
class IntRange:
    name: str
    low: int
    high: int
    step: int = 1


@dataclass(frozen=True)
class FloatRange:
    name: str
    low: float
    high: float
    log: bool = False
    step: float | None = None


@dataclass(frozen=True)
class Choice:
    name: str
    options: tuple


# fixed values: the search ranges of the study
DEPTHWISE_SPACE = (
    IntRange("n_estimators", 100, 800, 50),
    FloatRange("learning_rate", 0.005, 0.08, log=True),
    IntRange("max_depth", 2, 5),
    FloatRange("min_rows", 5.0, 80.0, log=True),
    FloatRange("subsample", 0.6, 1.0),
    FloatRange("column_fraction", 0.2, 0.8),
    FloatRange("min_gain", 1e-4, 1.0, log=True),
)
LEAFWISE_SPACE = (
    IntRange("n_estimators", 100, 800, 50),
    FloatRange("learning_rate", 0.005, 0.08, log=True),
    IntRange("max_depth", 2, 5),
    Choice("num_leaves", (3, 5, 7, 11, 15, 23, 31)),
    IntRange("min_rows", 20, 120, 10),
    FloatRange("min_gain", 0.0, 0.1),
    FloatRange("subsample", 0.6, 1.0, step=0.05),
    FloatRange("column_fraction", 0.15, 0.8, step=0.05),
    Choice("max_bin", (31, 63, 127)),
)
# end fixed values


def uniform(seed: int, trial: Column, name: str) -> Column:
    """A number in [0, 1) that depends on seed, trial and parameter name only."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), trial.cast("string"), F.lit(name)))
    whole = F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("bigint")
    return whole.cast("double") / F.lit(float(16**HEX_DIGITS))


def _pick(u: Column, options: Column) -> Column:
    return F.get(options, F.floor(u * F.size(options)).cast("int"))


def draw(spec, seed: int, trial: Column) -> Column:
    u = uniform(seed, trial, spec.name)
    if isinstance(spec, Choice):
        return _pick(u, F.array(*[F.lit(o) for o in spec.options]))
    if isinstance(spec, IntRange):
        n = (spec.high - spec.low) // spec.step + 1
        return (F.lit(spec.low) + F.floor(u * n) * spec.step).cast("int")
    if spec.log:
        low, high = math.log(spec.low), math.log(spec.high)
        return F.exp(F.lit(low) + u * F.lit(high - low))
    if spec.step is not None:
        n = round((spec.high - spec.low) / spec.step) + 1
        return F.lit(spec.low) + F.floor(u * n) * F.lit(spec.step)
    return F.lit(spec.low) + u * F.lit(spec.high - spec.low)


def search_trials(
    design: DataFrame,
    n_trials: int,
    windows: Sequence[int],
    lags: Sequence[int],
    space: Sequence,
    seed: int = params.SEED,
) -> DataFrame:
    """One row per trial: window (of those that fit the design), lags, and a draw for
    every parameter of the space."""
    room = design.agg(F.max("max_window").alias("room")).scalar()
    options = F.filter(
        F.array(*[F.lit(w) for w in sorted(set(windows))]), lambda w: w <= F.col("room")
    )
    trial = F.col("trial")
    return (
        design.sparkSession.range(n_trials)
        .select(F.col("id").cast("int").alias("trial"), room.alias("room"))
        .select(
            "trial",
            _pick(uniform(seed, trial, "window_months"), options).alias("window_months"),
            draw(Choice("target_lags", tuple(lags)), seed, trial).alias("target_lags"),
            *[draw(spec, seed, trial).alias(spec.name) for spec in space],
        )
    )


# ------------------------------------------------------- curves and stopping


def running_rmse(folds: DataFrame, study: str = "study") -> DataFrame:
    """Pooled RMSE after each fold. `folds` has one row per (study, trial, step), so a
    window partition is as long as the validation period."""
    so_far = (
        Window.partitionBy(study, "trial")
        .orderBy("step")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return folds.withColumn(
        "running_rmse", F.sqrt(F.sum("sse").over(so_far) / F.sum("n").over(so_far))
    )


def _median(values: Column) -> Column:
    ordered = F.array_sort(values)
    n = F.size(ordered)
    low = F.get(ordered, F.floor((n - 1) / F.lit(2)).cast("int"))
    high = F.get(ordered, F.floor(n / F.lit(2)).cast("int"))
    return (low + high) / F.lit(2.0)


def median_stopping(
    curves: DataFrame,
    startup_trials: int = params.STARTUP_TRIALS,
    warmup_months: int = params.WARMUP_MONTHS,
    study: str = "study",
) -> DataFrame:
    """(study, trial, state, last_step, value): which trials the median rule stops.

    From the `warmup_months`-th month on, a trial stops at the first step at which its
    best running RMSE so far is above the median of the earlier completed trials at the
    same step, once `startup_trials` of them are complete. Whether a trial completes
    thus depends on the ones before it, so a study's trials are folded in order. A
    study's group holds trials x months numbers: the search budget, not data.
    """
    steps = F.array_sort(F.collect_list(F.struct("step", "running_rmse")))
    per_trial = curves.groupBy(study, "trial").agg(steps["running_rmse"].alias("curve"))
    per_study = per_trial.groupBy(study).agg(
        F.array_sort(F.collect_list(F.struct("trial", "curve"))).alias("trials")
    )
    start = F.struct(
        F.array().cast("array<array<double>>").alias("complete"),
        F.array().cast("array<struct<trial:int,stop:int,length:int,value:double>>").alias("rows"),
    )

    def step(acc: Column, t: Column) -> Column:
        curve = t["curve"]
        positions = F.sequence(F.lit(0), F.size(curve) - 1)
        stops = F.filter(
            positions,
            lambda s: (s >= warmup_months - 1)
            & (
                F.array_min(F.slice(curve, 1, s + 1))
                > _median(
                    F.filter(
                        F.transform(acc["complete"], lambda c: F.get(c, s)),
                        lambda v: v.isNotNull(),
                    )
                )
            ),
        )
        enough = F.size(acc["complete"]) >= max(startup_trials, 1)
        stop = F.when(enough, F.get(stops, F.lit(0)))
        row = F.struct(
            t["trial"].cast("int").alias("trial"),
            stop.cast("int").alias("stop"),
            F.size(curve).alias("length"),
            F.get(curve, F.coalesce(stop, F.size(curve) - 1)).alias("value"),
        )
        return F.struct(
            F.when(stop.isNull(), F.array_append(acc["complete"], curve))
            .otherwise(acc["complete"])
            .alias("complete"),
            F.array_append(acc["rows"], row).alias("rows"),
        )

    folded = per_study.select(
        study, F.explode(F.aggregate("trials", start, step, lambda acc: acc["rows"])).alias("r")
    )
    return folded.select(
        study,
        "r.trial",
        F.when(F.col("r.stop").isNull(), "complete").otherwise("stopped").alias("state"),
        (F.coalesce("r.stop", F.col("r.length") - 1) + 1).alias("months_evaluated"),
        F.col("r.value").alias("value"),
    )


def best_trial(states: DataFrame, study: str = "study") -> DataFrame:
    """The completed trial with the lowest value, the earlier one on a tie."""
    row = F.struct("trial", "months_evaluated", "value")
    return (
        states.filter("state = 'complete'")
        .groupBy(study)
        .agg(F.min_by(row, F.struct("value", "trial")).alias("b"))
        .select(study, "b.trial", "b.months_evaluated", "b.value")
    )


def trial_counts(states: DataFrame, study: str = "study") -> DataFrame:
    return states.groupBy(study).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("state") == "complete").alias("complete"),
        F.count_if(F.col("state") == "stopped").alias("stopped"),
    )


def with_failed(states: DataFrame, trials: DataFrame, study: str = "study") -> DataFrame:
    """States of all trials: one that built not every validation month has no curve and failed."""
    gone = trials.select(study, "trial").join(states, [study, "trial"], "left_anti")
    empty = {f.name: F.lit(None).cast(f.dataType) for f in states.schema if f.name not in (study, "trial")}
    failed = gone.withColumns(empty | {"state": F.lit("failed"), "months_evaluated": F.lit(0)})
    return states.unionByName(failed.select(*states.columns))


def state_counts(states: DataFrame, study: str = "study") -> DataFrame:
    """`trial_counts` with the failed trials of `with_failed` beside the others."""
    failed = states.groupBy(study).agg(F.count_if(F.col("state") == "failed").alias("failed"))
    return trial_counts(states, study).join(failed, study)


def monthly_rmse(folds: DataFrame, study: str = "study") -> DataFrame:
    """Per trial the list of monthly RMSEs, rounded to 10 places."""
    pair = F.struct("step", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))
    return (
        folds.groupBy(study, "trial")
        .agg(F.array_sort(F.collect_list(pair)).alias("m"))
        .select(study, "trial", F.transform("m.rmse", lambda x: F.round(x, 10)).alias("monthly_rmse"))
    )


def zero_change_rmse(panel: DataFrame, design: DataFrame, target: str = TARGET) -> DataFrame:
    """RMSE of the zero forecast over the validation months; NULL without rows."""
    months = design.filter("role = 'validation'").select("month")
    return panel.join(F.broadcast(months), "month").agg(
        F.sqrt(F.avg(F.col(target) * F.col(target))).alias("benchmark_rmse"),
        F.count(target).alias("n"),
    )


# ------------------------------------------------- autoregression as candidate


def ar_folds(
    indexed: DataFrame,
    design: DataFrame,
    trials: DataFrame,
    regressors: Sequence[str],
    reference: str,
    target: str = TARGET,
) -> DataFrame:
    """(study, trial, step, n, sse) of autoregression trials, all in one plan.

    `trials` has (study, trial, window_months, target_lags), a search budget's worth of
    rows; `regressors[k]` is the column that a trial with `target_lags = k` uses. Every
    pair of window and lag is fitted once, however many trials share it: the panel is
    unpivoted to one row per regressor and summed over one frame per window. Trials meet
    the small table of pairs and months at the end.
    """
    validation = design.filter("role = 'validation'").select(F.col("month_idx").alias("test_idx"))
    first = validation.agg(F.min("test_idx")).scalar()
    pairs = F.array(
        *[
            F.struct(F.lit(k).alias("target_lags"), F.col(name).alias("x"))
            for k, name in enumerate(regressors)
        ]
    )
    used = trials.select("target_lags").distinct()
    narrow = (
        indexed.select("month_idx", "entity", F.col(target).alias("y"), F.inline(pairs))
        .dropna(subset=["x", "y"])
        .join(F.broadcast(used), "target_lags", "left_semi")
    )
    test = narrow.withColumnRenamed("month_idx", "test_idx").join(
        F.broadcast(validation), "test_idx"
    )
    windows = sorted(r.window_months for r in trials.select("window_months").distinct().collect())
    moments = reduce(
        DataFrame.unionByName,
        [
            rolling_moments(narrow, validation, w, ["target_lags"]).withColumn(
                "window_months", F.lit(w)
            )
            for w in windows
        ],
    )
    sizes = F.explode(F.array(*[F.lit(w) for w in windows])).alias("window_months")
    keys = ["window_months", "target_lags", "test_idx"]
    fits = fixed_effect_forecasts(moments, test.select("*", sizes), keys, reference)
    error = F.col("y") - F.col("prediction")
    folds = fits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(error * error).alias("sse")
    )
    return folds.join(
        F.broadcast(trials.select("study", "trial", "window_months", "target_lags")),
        ["window_months", "target_lags"],
    ).select("study", "trial", (F.col("test_idx") - first).cast("int").alias("step"), "n", "sse")


def complete_folds(folds: DataFrame, trials: DataFrame, design: DataFrame) -> DataFrame:
    """Folds of the trials that have them all: a trial scored on fewer months may not win."""
    failed = incomplete_trials(folds, trials, design).select("study", "trial")
    return folds.join(failed, ["study", "trial"], "left_anti")


def incomplete_trials(folds: DataFrame, trials: DataFrame, design: DataFrame) -> DataFrame:
    """Trials that lack a fold, that is an empty training or validation month."""
    wanted = design.filter("role = 'validation'").agg(F.count(F.lit(1)).alias("n")).scalar()
    done = folds.groupBy("study", "trial").agg(F.count(F.lit(1)).alias("folds"))
    return (
        trials.select("study", "trial")
        .join(done, ["study", "trial"], "left")
        .select("study", "trial", F.coalesce("folds", F.lit(0)).alias("folds"))
        .filter(F.col("folds") < wanted)
    )


# ------------------------------------------------------ boosted trees as candidate


def _stop_step(
    curve: Sequence[float], start: int, complete: Sequence[Sequence[float]], startup: int, warmup: int
) -> int | None:
    """First step from `start` on at which the median rule stops the trial."""
    if len(complete) < max(startup, 1):
        return None
    for s in range(max(start, warmup - 1), len(curve)):
        if min(curve[: s + 1]) > statistics.median(c[s] for c in complete):
            return s
    return None


def tune_boosting(
    data_by_lags: dict[int, RollingData],
    validation_idx: Sequence[int],
    trials: Sequence[dict],
    settings: Callable[[dict], BoostingSettings],
    startup_trials: int = params.STARTUP_TRIALS,
    warmup_months: int = params.WARMUP_MONTHS,
    parallel_fits: int = 4,
) -> DataFrame:
    """(study, trial, step, n, sse) of every fold that was evaluated.

    Trials run in order, as the stopping rule looks back at completed ones. Within a
    trial, a batch of folds is fitted side by side and the rule is applied between
    batches; folds past the stopping step are dropped, so the result does not depend on
    the batch size. Only one number pair per fold reaches the driver.
    """
    spark: SparkSession = next(iter(data_by_lags.values())).rows.sparkSession
    complete: list[list[float]] = []
    folds: list[tuple] = []

    for trial in trials:
        data = data_by_lags[trial["target_lags"]]
        window, chosen = trial["window_months"], settings(trial)

        def evaluate(t: int) -> tuple[int, float]:
            if t < window or not data.counts.get(t, 0) or not data.n_train(t, window):
                raise DataCheckError(f"Empty training or validation sample at {data.months[t]}.")
            model = fit_split(data, t, window, chosen)
            error = F.col("actual") - F.col("prediction")
            row = (
                predict_split(data, model, t, window, chosen.model)
                .agg(F.count(F.lit(1)).alias("n"), F.sum(error * error).alias("sse"))
                .first()
            )
            return row.n, row.sse

        curve: list[float] = []
        results: list[tuple[int, float]] = []
        stop = None
        with ThreadPoolExecutor(max_workers=parallel_fits) as pool:
            for at in range(0, len(validation_idx), parallel_fits):
                results += pool.map(evaluate, validation_idx[at : at + parallel_fits])
                for i in range(at, len(results)):
                    sse = sum(r[1] for r in results[: i + 1])
                    curve.append(math.sqrt(sse / sum(r[0] for r in results[: i + 1])))
                stop = _stop_step(curve, at, complete, startup_trials, warmup_months)
                if stop is not None:
                    break
        if stop is None:
            complete.append(curve)
        kept = results if stop is None else results[: stop + 1]
        folds += [(0, trial["trial"], s, n, sse) for s, (n, sse) in enumerate(kept)]
    return spark.createDataFrame(folds, "study int, trial int, step int, n bigint, sse double")


# ------------------------------------------------------------------ the report


def tuning_report(
    model: str,
    trials: DataFrame,
    states: DataFrame,
    design: DataFrame,
    benchmark: DataFrame,
    panel: DataFrame,
    seed: int = params.SEED,
    mode: str = "at_or_before",
) -> DataFrame:
    """One row: the best trial, its settings, the benchmark ratio, the periods used and
    the panel. The test start is written as a month (`at_or_before`) or as the month end
    after development (`exact`); both admit the same months."""
    best = best_trial(states).withColumnRenamed("value", "best_rmse")
    config = trials.select(
        "study", "trial", F.struct(*[c for c in trials.columns if c != "study"]).alias("best_params")
    )
    ends = month_end(F.col("month"))

    def at(role: str, pick) -> Column:
        return pick(F.when(F.col("role") == role, ends))

    periods = design.agg(
        at("validation", F.min).alias("validation_start"),
        at("validation", F.max).alias("tuning_end"),
        at("holdout", F.min).alias("holdout_start"),
        at("holdout", F.max).alias("holdout_end"),
        F.count_if(F.col("role") == "validation").alias("n_validation"),
        F.count_if(F.col("role") == "holdout").alias("n_holdout"),
    )
    start = (
        day_text(next_month_end(F.col("tuning_end")))
        if mode == "exact"
        else month_text(F.col("holdout_start"))
    )
    shape = panel.agg(
        F.min("month").alias("first_month"),
        F.max("month").alias("last_month"),
        F.count_distinct("month").alias("n_months"),
        F.count_distinct("entity").alias("n_entities"),
        # as long as the panel's dummy columns
        F.array_sort(F.collect_set("entity")).alias("entities"),
        F.count(F.lit(1)).alias("n_rows"),
    )

    def only(df: DataFrame) -> Column:
        return df.select(F.struct("*").alias("s")).scalar()

    every = with_failed(states, trials)
    period, counts = only(periods.withColumn("test_start", start)), only(state_counts(every))
    return (
        best.join(config, ["study", "trial"])
        .withColumn("period", period)
        .withColumn("counts", counts)
        .withColumn("panel", only(shape))
        .withColumn("benchmark_rmse", only(benchmark)["benchmark_rmse"])
        .select(
            F.lit(model).alias("model"),
            F.col("trial").alias("best_trial"),
            "best_rmse",
            "benchmark_rmse",
            ratio(F.col("best_rmse"), F.col("benchmark_rmse")).alias("ratio_to_benchmark"),
            "best_params",
            F.col("period.validation_start").alias("validation_start"),
            F.col("period.tuning_end").alias("tuning_end"),
            F.col("period.n_validation").alias("n_validation"),
            F.col("period.test_start").alias("recommended_test_start"),
            F.col("period.holdout_start").alias("holdout_start"),
            F.col("period.holdout_end").alias("holdout_end"),
            F.col("period.n_holdout").alias("n_holdout"),
            F.col("counts.total").alias("n_trials"),
            F.col("counts.complete").alias("n_complete"),
            F.col("counts.stopped").alias("n_stopped"),
            F.col("counts.failed").alias("n_failed"),
            F.col("panel.first_month").alias("panel_first_month"),
            F.col("panel.last_month").alias("panel_last_month"),
            F.col("panel.n_months").alias("panel_months"),
            F.col("panel.n_entities").alias("panel_entities"),
            F.col("panel.entities").alias("entities"),
            F.col("panel.n_rows").alias("panel_rows"),
            F.lit(seed).alias("seed"),
            F.lit("pooled rolling-validation RMSE").alias("objective"),
            F.lit(False).alias("holdout_used_in_tuning"),
        )
    )
