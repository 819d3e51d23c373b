"""Rules that ride on writes: counts, errors with examples, and the jobs and shuffles they cost."""

import datetime as dt
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from monthloom.operators import compare, panel, rules
from monthloom.operators.checks import DataCheckError
from monthloom.operators.rules import Rule
from monthloom.sources import panel_store


def frame(spark, rows):
    return spark.createDataFrame(
        [(e, dt.date(2020, m, 28), x, 1.0, t) for e, m, x, t in rows],
        "entity string, month date, x double, level_lag1 double, target double",
    )


GOOD = [(e, m, float(m), 0.1) for e in "ABC" for m in range(1, 9)]


def jobs_of(spark, action):
    group = uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_counters_ride_on_the_write(spark, tmp_path):
    bad = frame(spark, [*GOOD, ("A", 3, 1.0, 0.2), ("A", 3, float("nan"), None), ("B", 9, None, 0.1)])
    own = [rules.unique("The key repeats."), rules.finite("x", "x is bad.", ["x"]), rules.finite("t", "t is bad.", ["target"])]
    found = rules.watched_by_key(bad, own, {"top": F.max("target")})
    found.frame.write.parquet(str(tmp_path / "rows"))
    counts = found.counts
    assert (counts["_rows"], counts["repeated_key"], counts["x"], counts["t"], counts["top"]) == (27, 2, 2, 1, 0.2)
    assert {r.rule: r.n_rows for r in rules.violations(bad, own).collect()} == {"repeated_key": 2, "x": 2, "t": 1}
    written = spark.read.parquet(str(tmp_path / "rows"))
    assert written.columns == bad.columns and written.count() == 27
    with pytest.raises(DataCheckError, match="The key repeats.*entity=A.*n=3"):
        found.require(written)


def test_a_sound_write_costs_no_job_and_no_shuffle_more(spark, tmp_path):
    rows = frame(spark, GOOD)
    plain = jobs_of(spark, lambda: panel_store.write_panel(rows, str(tmp_path / "a")))
    own = panel.combined_rules(rows, ["x"], "target")
    checked = jobs_of(spark, lambda: panel_store.write_checked(rows, str(tmp_path / "b"), own))
    assert checked == plain
    plan = rules.watched_by_key(rows, own).frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    a, b = (spark.read.parquet(str(tmp_path / x)) for x in "ab")
    assert sorted(a.collect()) == sorted(b.collect())
    # one query; adaptive execution runs each of its three stages as a job
    assert jobs_of(spark, lambda: rules.check(rows, own)) == 3


def test_a_panel_at_rest_is_checked_by_one_aggregation(spark):
    rows = frame(spark, GOOD).withColumns({"C_B": (F.col("entity") == "B").cast("int"), "C_C": (F.col("entity") == "C").cast("int")})
    panel.check_combined(rows, ["x"], "target")
    with pytest.raises(DataCheckError, match="dummies of a row are not those.*entity=B"):
        panel.check_panel(rows.withColumn("C_B", F.lit(0)), ["x"])
    with pytest.raises(DataCheckError, match="Expected 1 dummies, found 2"):
        panel.check_panel(rows.where("entity <> 'C'"), ["x"])
    with pytest.raises(DataCheckError, match="combined panel has missing"):
        panel.check_combined(rows.withColumn("target", F.lit(None).cast("double")), ["x"], "target")


def test_rules_of_levels_name_what_is_wrong(spark):
    rows = spark.createDataFrame(
        [(dt.date(2020, 1, 31), "A", "m", 0.1, 0.1, 5.0, 5.1), (dt.date(2020, 1, 31), "B", "m", 0.1, 0.2, 5.0, -1.0),
         (dt.date(2020, 1, 31), "C", "m", 0.1, None, None, None)],
        "month date, entity string, model string, actual double, panel_target double, level_lag1 double, actual_level double",
    )
    found = {r.rule: r.n_rows for r in rules.violations(rows, compare.level_rules()).collect()}
    assert found == {"unmatched": 1, "other_outcome": 1, "level_not_positive": 1}
    with pytest.raises(DataCheckError, match="no panel row.*entity=C"):
        compare.check_levels(rows)


def test_a_rule_without_example_rows_still_raises(spark):
    rows = frame(spark, GOOD)
    found = rules.watched(rows, [Rule("late", "Too late.", F.col("month") > "2020-07-01")])
    found.frame.write.format("noop").mode("overwrite").save()
    with pytest.raises(DataCheckError, match="Too late. Rows: 6"):
        found.require(rows.limit(0))
