import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from monthloom.operators import boosting, splits, tuning
from monthloom.operators.boosting import BoostingSettings, leafwise_defaults


def curves_frame(spark, curves):
    rows = [(0, t, s, v) for t, curve in enumerate(curves) for s, v in enumerate(curve)]
    return spark.createDataFrame(rows, "study int, trial int, step int, running_rmse double").repartition(3)


def replay(curves, startup, warmup):
    """The stopping rule, one trial and one month at a time."""
    complete, out = [], []
    for curve in curves:
        stop = None
        for s in range(len(curve)):
            if len(complete) < max(startup, 1) or s < warmup - 1:
                continue
            if min(curve[: s + 1]) > statistics.median(c[s] for c in complete):
                stop = s
                break
        if stop is None:
            complete.append(curve)
        out.append(("complete", len(curve), curve[-1]) if stop is None else ("stopped", stop + 1, curve[stop]))
    return out


@pytest.mark.parametrize("startup, warmup", [(5, 3), (1, 1), (0, 0), (3, 9)])
def test_median_stopping_equals_replay(spark, startup, warmup):
    rng = random.Random(startup * 10 + warmup)
    curves = [[rng.uniform(1, 3) for _ in range(8)] for _ in range(25)]
    got = tuning.median_stopping(curves_frame(spark, curves), startup, warmup).orderBy("trial")
    assert [(r.state, r.months_evaluated, r.value) for r in got.collect()] == replay(curves, startup, warmup)


def test_a_stopped_trial_does_not_count(spark):
    """The third trial is compared with the completed first one only."""
    curves = [[1.0, 1.0], [9.0, 9.0], [2.0, 2.0]]
    states = tuning.median_stopping(curves_frame(spark, curves), 1, 1).orderBy("trial")
    assert [r.state for r in states.collect()] == ["complete", "stopped", "stopped"]
    counts = tuning.trial_counts(states).first()
    assert (counts.total, counts.complete, counts.stopped) == (3, 1, 2)
    assert tuning.best_trial(states).first().trial == 0


def test_truncated_curves_give_the_same_states(spark):
    rng = random.Random(1)
    curves = [[rng.uniform(1, 3) for _ in range(6)] for _ in range(12)]
    full = replay(curves, 2, 2)
    cut = [c[: n] for c, (_, n, _) in zip(curves, full)]
    got = tuning.median_stopping(curves_frame(spark, cut), 2, 2).orderBy("trial").collect()
    assert [(r.state, r.months_evaluated, r.value) for r in got] == full


def test_driver_rule_agrees(spark):
    rng = random.Random(3)
    curves = [[rng.uniform(1, 3) for _ in range(7)] for _ in range(15)]
    complete, states = [], []
    for curve in curves:
        stop = None
        for at in range(0, 7, 3):  # batches of three folds
            stop = tuning._stop_step(curve[: min(at + 3, 7)], at, complete, 4, 3)
            if stop is not None:
                break
        if stop is None:
            complete.append(curve)
        states.append("complete" if stop is None else "stopped")
    assert states == [s for s, _, _ in replay(curves, 4, 3)]


def test_best_trial_prefers_the_earlier_on_a_tie(spark):
    states = tuning.median_stopping(curves_frame(spark, [[2.0], [1.0], [1.0]]), 9, 1)
    assert tuning.best_trial(states).first().trial == 1


def test_running_rmse(spark):
    folds = spark.createDataFrame(
        [(0, 0, 1, 2, 6.0), (0, 0, 0, 2, 2.0)], "study int, trial int, step int, n bigint, sse double"
    )
    rows = tuning.running_rmse(folds).orderBy("step").collect()
    assert [r.running_rmse for r in rows] == [1.0, math.sqrt(2.0)]
    assert tuning.monthly_rmse(folds).first().monthly_rmse == [1.0, round(math.sqrt(3.0), 10)]


def design_frame(spark, n=60, holdout=10, validation=6):
    axis = spark.createDataFrame([(i,) for i in range(n)], "month_idx int").withColumn(
        "month", F.last_day(F.add_months(F.lit("2000-01-01").cast("date"), F.col("month_idx")))
    )
    return splits.validation_design(axis, [12, 24], validation, holdout, mode="exact")


def test_search_space(spark):
    design = design_frame(spark)
    make = lambda seed: tuning.search_trials(
        design, 400, [12, 24, 96], (0, 1, 2, 3), tuning.LEAFWISE_SPACE, seed
    ).orderBy("trial").collect()
    rows = make(42)
    assert rows == make(42) and rows != make(43)
    assert {r.window_months for r in rows} == {12, 24}  # 96 months do not fit
    assert {r.target_lags for r in rows} == {0, 1, 2, 3}
    assert {r.num_leaves for r in rows} == {3, 5, 7, 11, 15, 23, 31}
    assert {r.n_estimators for r in rows} == set(range(100, 801, 50))
    assert {r.min_rows for r in rows} == set(range(20, 121, 10))
    assert {round(r.subsample, 6) for r in rows} == {round(0.6 + 0.05 * i, 6) for i in range(9)}
    assert all(0.005 <= r.learning_rate <= 0.08 and 0 <= r.min_gain <= 0.1 for r in rows)
    middle = math.sqrt(0.005 * 0.08)  # half of the log-uniform draws lie below
    assert 150 < sum(r.learning_rate < middle for r in rows) < 250
    deep = tuning.search_trials(design, 50, [12], (1,), tuning.DEPTHWISE_SPACE).collect()
    assert all(2 <= r.max_depth <= 5 and 5 <= r.min_rows <= 80 for r in deep)


def test_benchmark(spark):
    design = design_frame(spark)
    panel = design.withColumn("target", F.lit(2.0)).select("month", "target")
    row = tuning.zero_change_rmse(panel, design).first()
    assert (row.benchmark_rmse, row.n) == (2.0, 6)
    none = tuning.zero_change_rmse(panel.limit(0), design).first()
    assert none.benchmark_rmse is None


def test_incomplete_trials(spark):
    trials = spark.createDataFrame([(0, 0), (0, 1)], "study int, trial int")
    folds = spark.createDataFrame([(0, 0, s, 1, 1.0) for s in range(6)], "study int, trial int, step int, n bigint, sse double")
    rows = tuning.incomplete_trials(folds, trials, design_frame(spark)).collect()
    assert [(r.trial, r.folds) for r in rows] == [(1, 0)]


def test_boosting_settings():
    with pytest.raises(ValueError, match="no L1 or L2"):
        BoostingSettings(reg_lambda=5.0)
    with pytest.raises(ValueError, match="positive"):
        BoostingSettings(n_estimators=0)
    assert leafwise_defaults().depth == 4
    assert leafwise_defaults(num_leaves=5, max_depth=5).depth == 3
    assert leafwise_defaults(num_leaves=3, max_depth=1).depth == 1
    assert BoostingSettings(max_depth=3).depth == 3


def test_tree_fits_can_be_repeated(spark):
    """Two stagings, with other shuffle partitions, give equal forecasts."""
    import numpy as np

    rng = np.random.default_rng(9)
    rows = [
        (e, dt.date(2020 + m // 12, m % 12 + 1, 28), float(rng.normal()), float(rng.normal()), float(rng.normal()))
        for e in "ABCDEFGH"
        for m in range(14)
    ]
    frame = spark.createDataFrame(rows, "entity string, month date, x double, z double, target double")
    settings = BoostingSettings(n_estimators=4, learning_rate=0.3, min_rows=2)
    results = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("4", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            data = boosting.prepare(frame.repartition(int(parts)), ["x", "z"])
            out = boosting.rolling_boosting(data, 12, settings).predictions
            results.append(sorted((r.entity, r.month, r.prediction) for r in out.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] and len(results[0]) == 16


def test_a_trial_that_lacks_a_fold_is_left_out(spark):
    design = spark.createDataFrame([(i, "validation") for i in (5, 6)], "month_idx int, role string")
    trials = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "study int, trial int")
    folds = spark.createDataFrame(
        [(0, 1, 0, 1, 2.0), (0, 1, 1, 1, 2.0), (0, 2, 0, 1, 0.1)], "study int, trial int, step int, n bigint, sse double"
    )
    assert {r.trial for r in tuning.incomplete_trials(folds, trials, design).collect()} == {2, 3}
    complete = tuning.complete_folds(folds, trials, design)
    assert {r.trial for r in complete.collect()} == {1}
    states = tuning.with_failed(tuning.median_stopping(tuning.running_rmse(complete), 1, 1), trials)
    assert {(r.trial, r.state, r.months_evaluated) for r in states.collect()} == {
        (1, "complete", 2), (2, "failed", 0), (3, "failed", 0)
    }
    counts = tuning.state_counts(states).first()
    assert (counts.total, counts.complete, counts.stopped, counts.failed) == (3, 1, 0, 2)
    assert tuning.best_trial(states).first().trial == 1
