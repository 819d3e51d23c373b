"""Shape of the physical plans."""

import re
from pathlib import Path

import pytest

from monthloom.operators import breaks, detrend, forecast, splits, target
from monthloom.operators.series import pack
from monthloom.plans import catalogue, inputs
from monthloom.session import checkpoint_folder

SMALL = "/root/testdata/sf0.001"
FITS = {"gbt_depthwise", "gbt_leafwise", "gbt_importance", "tuned_vs_benchmark"}


def written_parts(spark):
    return Path(checkpoint_folder(spark).removeprefix("file:")).rglob("part-*")


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalogue.all_queries()) - FITS))
def test_no_cross_joins_and_no_row_wise_python(spark, name):
    plan = plan_of(catalogue.all_queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(inputs.feature_series(spark, SMALL))
    assert re.search(r"PushedFilters: \[[^\]]*IsNotNull\(l_suppkey", plan)
    scan = next(line for line in plan.splitlines() if "lineitem" in line)
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_extendedprice:double,l_shipdate:timestamp_ntz>" in scan


def test_packed_steps_share_one_shuffle(spark):
    """Breaks, shift and trend follow the one shuffle on the series key."""
    long = spark.createDataFrame(
        [], "entity string, feature string, kind string, month date, value double"
    ).repartition(4)
    trended = detrend.with_trend(
        detrend.flag_varying(detrend.shift_to_positive(breaks.adjust_breaks(long, inputs.BREAKS)))
    )
    assert plan_of(trended).count("Exchange hashpartitioning") == 1
    assert plan_of(pack(long)).count("Exchange hashpartitioning") == 1


def test_gap_fill_lag_and_change_share_one_sort(spark):
    frame = spark.createDataFrame([], "entity string, month date, level double").repartition(4)
    plan = plan_of(target.with_target(target.add_change(target.fill_isolated_gaps(frame))))
    assert plan.count("Exchange hashpartitioning") == 1 and len(re.findall(r"\bSort \[", plan)) == 1


def test_rolling_join_is_an_equi_join(spark):
    frame = spark.createDataFrame(
        [], "entity string, month date, level_lag1 double, target double"
    ).repartition(4)
    axis = splits.month_axis(frame)
    plan = plan_of(
        forecast.pooled_ar(
            splits.with_month_idx(frame, axis), splits.rolling_splits(axis, 12), 12
        )
    )
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_staged_results_survive_a_lost_executor(spark):
    """Lineage is cut by files in the named folder, not by blocks on executors, and later
    steps read only the columns they need of them."""
    before = set(written_parts(spark))
    changes = catalogue._staged_changes(spark, SMALL)
    plan = plan_of(changes.groupBy("entity").count())
    assert "FileScan parquet" in plan and "ReadSchema: struct<entity:string>" in plan
    assert "ExistingRDD" not in plan
    assert set(written_parts(spark)) - before


def test_staged_tables_can_be_released(spark):
    from monthloom.session import release, scratch, stage

    staged = lambda: [p for p in written_parts(spark) if spark.sparkContext.applicationId in str(p)]
    with scratch(spark) as tables:
        gone, kept = stage(spark.range(3)), tables.keep(stage(spark.range(5)))
    assert kept.count() == 5
    with pytest.raises(Exception, match="does not exist|FILE_NOT_EXIST"):
        gone.collect()
    assert staged()
    release(spark)
    assert not staged()


def test_tree_queries_fit_with_the_defaults_of_the_jobs(monkeypatch):
    from monthloom.operators import boosting
    from monthloom.plans import catalogue

    asked = []

    class Asked(Exception):
        pass

    def fit(spark, sf_dir, settings):
        asked.append(settings)
        raise Asked

    monkeypatch.setattr(catalogue, "_boost", fit)
    for name in ("gbt_depthwise", "gbt_leafwise", "gbt_importance"):
        with pytest.raises(Asked):
            getattr(catalogue, name)(None, "")
    assert asked == [boosting.BoostingSettings(), boosting.leafwise_defaults(), boosting.BoostingSettings()]
    assert {s.n_estimators for s in asked} == {300}
