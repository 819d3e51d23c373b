import datetime as dt

import pytest
from pyspark.sql import functions as F

from monthloom.operators import checks, coverage, lags, panel, target
from monthloom.operators.checks import DataCheckError
from monthloom.sources import panel_store


def end(year, month):
    nxt = dt.date(year + month // 12, month % 12 + 1, 1)
    return nxt - dt.timedelta(days=1)


def rates_frame(spark, levels, entity="A", start=2020, skip=()):
    rows = [
        (entity, end(start + i // 12, i % 12 + 1), v)
        for i, v in enumerate(levels)
        if i not in skip
    ]
    return spark.createDataFrame(rows, "entity string, month date, level double")


def ordered(df, column):
    return [r[column] for r in df.orderBy("entity", "month").collect()]


def test_only_isolated_gaps_are_filled(spark):
    levels = [None, 2.0, None, 4.0, None, None, 7.0, 8.0, None]
    filled = target.fill_isolated_gaps(rates_frame(spark, levels))
    assert ordered(filled, "level") == [None, 2.0, 3.0, 4.0, None, None, 7.0, 8.0, None]
    assert ordered(filled, "imputed") == [False, False, True] + [False] * 6
    assert [r.imputed_value for r in target.imputed_rates(filled).collect()] == [3.0]
    assert target.remaining_gaps(filled).count() == 4
    audit = {r.status: r.n_months for r in target.gap_audit(filled).collect()}
    assert audit == {"filled": 1, "remaining": 4}


def test_a_missing_panel_row_blocks_fill_and_lag(spark):
    # month 3 (index 2) is not in the panel at all
    frame = rates_frame(spark, [1.0, None, 3.0, 4.0, 5.0], skip=(2,))
    changed = target.add_change(target.fill_isolated_gaps(frame))
    assert ordered(changed, "level_lag1") == [None, 1.0, None, 4.0]
    assert ordered(changed, "target") == [None, None, None, 1.0]
    assert "level" not in changed.columns


def test_an_imputed_rate_serves_as_lag(spark):
    changed = target.add_change(target.fill_isolated_gaps(rates_frame(spark, [2.0, None, 4.0])))
    assert ordered(changed, "level_lag1") == [None, 2.0, 3.0]
    assert ordered(target.with_target(changed), "target") == [1.0, 1.0]


def test_attach_rates_checks(spark):
    keys = rates_frame(spark, [1.0, 2.0]).drop("level")
    other = rates_frame(spark, [1.0], entity="B")
    with pytest.raises(DataCheckError, match="no rates.*entity=A"):
        target.attach_rates(keys, other)
    doubled = rates_frame(spark, [1.0]).unionByName(rates_frame(spark, [2.0]))
    with pytest.raises(DataCheckError, match="rates repeat"):
        target.attach_rates(keys, doubled)
    with pytest.raises(DataCheckError, match="panel repeats"):
        target.attach_rates(keys.unionByName(keys), rates_frame(spark, [1.0]))


def changes(spark, values, entity="A", skip=()):
    return rates_frame(spark, values, entity, skip=skip).withColumnRenamed("level", "target")


def test_target_lags_respect_gaps(spark):
    frame = changes(spark, [1.0, 2.0, 3.0, 4.0, 5.0], skip=(2,))
    lagged = lags.add_target_lags(frame, 3)
    assert ordered(lagged, "target_lag1") == [None, 1.0, None, 4.0]
    assert ordered(lagged, "target_lag2") == [None, None, None, None]
    assert lags.add_target_lags(frame, 0).columns == frame.columns
    with pytest.raises(ValueError):
        lags.add_target_lags(frame, -1)


def test_existing_lags_are_checked(spark):
    frame = changes(spark, [1.0, 2.0, 3.0])
    good = lags.add_target_lags(frame, 1)
    assert ordered(lags.add_target_lags(good, 2), "target_lag1") == [None, 1.0, 2.0]
    bad = good.withColumn("target_lag1", F.col("target_lag1") + 0.1)
    with pytest.raises(DataCheckError, match="disagrees.*target_lag1"):
        lags.add_target_lags(bad, 1)
    # a lag that is missing where history exists is a disagreement as well
    empty = good.withColumn("target_lag1", F.lit(None).cast("double"))
    with pytest.raises(DataCheckError, match="disagrees"):
        lags.add_target_lags(empty, 1)


def test_feature_lists():
    assert lags.without_target_lags(["x", "target_lag1", "target_lag", "target_lagx", "target_lag12"]) == [
        "x", "target_lag", "target_lagx",
    ]
    assert lags.model_features(["b", "a", "target_lag1"], 2) == ["b", "a", "target_lag1", "target_lag2"]


def long_frame(spark, cells):
    rows = [(e, f, "topic", dt.date(2020, m, 1), v) for e, f, m, v in cells]
    return spark.createDataFrame(
        rows, "entity string, feature string, kind string, month date, value double"
    )


def test_balanced_panel(spark):
    cells = [(e, f, m, float(m)) for e in "CBA" for f in "yx" for m in (1, 2)]
    cells = [c for c in cells if c[:3] != ("B", "x", 2)] + [("B", "x", 2, None)]
    built, features = panel.build_panel(long_frame(spark, cells), reference="B")
    assert features == ["x", "y"]
    assert built.columns == ["month", "entity", "x", "y", "C_A", "C_C"]
    rows = {(r.entity, r.month): (r.x, r.y, r.C_A, r.C_C) for r in built.collect()}
    assert len(rows) == 5 and ("B", dt.date(2020, 2, 29)) not in rows
    assert rows["A", dt.date(2020, 1, 31)] == (1.0, 1.0, 1, 0)
    assert rows["B", dt.date(2020, 1, 31)] == (1.0, 1.0, 0, 0)
    assert panel.incomplete_rows(long_frame(spark, cells), 2).first().rows_dropped == 1
    panel.check_panel(built, features)
    summary = panel.panel_summary(built, features).first()
    assert (summary.n_entities, summary.n_features, summary.n_dummies, summary.n_rows) == (3, 2, 2, 5)
    with pytest.raises(DataCheckError, match="Excluded entities.*entity=C"):
        panel.check_panel(built, features, excluded=("C",))
    with pytest.raises(DataCheckError, match="Expected 1 dummies, found 2"):
        panel.check_panel(built.filter("entity <> 'C'"), features)
    with pytest.raises(DataCheckError, match="non-finite"):
        panel.check_panel(built.withColumn("x", F.lit(float("nan"))), features)
    with pytest.raises(DataCheckError, match="repeats"):
        panel.check_panel(built.unionByName(built), features)


def test_dummy_order():
    assert panel.dummy_order(["US", "AU", "DE"], "AU") == ["AU", "DE", "US"]
    assert panel.dummy_order(["US", "DE"], "AU") == ["DE", "US"]


def test_uneven_coverage(spark):
    cells = [("A", "x", 1, 1.0), ("A", "y", 1, 1.0), ("B", "x", 1, 1.0), ("B", "z", 1, 1.0)]
    frame = long_frame(spark, cells)
    rows = {r.entity: (r.n_features, r.n_missing, r.n_extra) for r in coverage.feature_coverage(frame).collect()}
    assert rows == {"A": (2, 1, 1), "B": (2, 1, 1)}
    gaps = {(r.entity, r.feature) for r in coverage.feature_gaps(frame).collect()}
    assert gaps == {("A", "z"), ("B", "y")}
    with pytest.raises(DataCheckError, match="differ in their features.*A:z"):
        panel.build_panel(frame)
    coverage.require_equal_coverage(frame.filter("feature = 'x'"))


def test_empty_panel_is_an_error(spark):
    frame = long_frame(spark, [("A", "x", 1, None), ("B", "x", 1, None)])
    with pytest.raises(DataCheckError, match="No complete entity-month"):
        panel.build_panel(frame)


def test_calendar_gaps_and_skeleton(spark):
    cells = [("A", "x", m, 1.0) for m in (1, 2, 4)] + [("B", "x", m, 1.0) for m in (2, 3)]
    frame = long_frame(spark, cells)
    gaps = {(r.entity, r.month.month) for r in coverage.calendar_gaps(frame).collect()}
    assert gaps == {("A", 3), ("B", 1), ("B", 4)}
    assert coverage.skeleton(frame).count() == 8
    assert [r.n_missing for r in coverage.top_missing(frame, 1).collect()] == [2]
    # a month in which no series has data is missing for all
    hole = long_frame(spark, [("A", "x", m, 1.0) for m in (1, 3)])
    assert coverage.calendar_gaps(hole).count() == 1


def test_dimension_values(spark):
    frame = spark.createDataFrame([("a", "x"), ("a", None), ("b", None)], "d1 string, d2 string")
    bad = checks.unexpected_dimension_values(frame, {"d1": "a", "d2": "y"})
    assert {(r.dimension, r.value, r.n_rows) for r in bad.collect()} == {
        ("d1", "b", 1), ("d2", "x", 1), ("d2", "y", 0)
    }


def model_panel(spark):
    rows = [
        ("A", end(2020, 1), 1.0, 5.0, 0.1), ("A", end(2020, 2), 2.0, 5.1, 0.2),
        ("B", end(2020, 1), 3.0, 4.0, 0.3), ("B", end(2020, 2), 4.0, 4.3, 0.4),
    ]
    return spark.createDataFrame(
        rows, "entity string, month date, x double, level_lag1 double, target double"
    )


def test_panel_store(spark, tmp_path):
    frame = model_panel(spark)
    path = str(tmp_path / "panel")
    panel_store.write_panel(frame, path)
    loaded, features = panel_store.load_panel(spark, path)
    assert features == ["x", "level_lag1"]
    assert sorted(loaded.select(*frame.columns).collect()) == sorted(frame.collect())
    keys = panel_store.level_keys(spark, path)
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<entity:string,month:date,level_lag1:double,target:double>" in plan
    csv = str(tmp_path / "panel_csv")
    panel_store.write_panel(frame, csv, csv=True)
    loaded, _ = panel_store.load_panel_csv(spark, csv, ["x"])
    assert sorted(loaded.select(*frame.columns).collect()) == sorted(frame.collect())


def test_entity_codes_stay_text(spark, tmp_path):
    frame = spark.createDataFrame(
        [(e, dt.date(2020, 1, 31), 1.0, 2.0, 3.0) for e in ("01", "1", "10")],
        "entity string, month date, x double, level_lag1 double, target double",
    )
    path = str(tmp_path / "panel")
    panel_store.write_panel(frame, path)
    loaded, _ = panel_store.load_panel(spark, path)
    assert dict(loaded.dtypes)["entity"] == "string"
    assert sorted(r.entity for r in loaded.collect()) == ["01", "1", "10"]


def test_model_panel_rules(spark):
    frame = model_panel(spark)
    check = panel_store.check_model_panel
    with pytest.raises(DataCheckError, match="gives the outcome away"):
        check(frame.withColumn("level", F.lit(1.0)))
    with pytest.raises(DataCheckError, match="lacks the columns.*level_lag1"):
        check(frame.drop("level_lag1"))
    with pytest.raises(DataCheckError, match="must be numeric.*note"):
        check(frame.withColumn("note", F.lit("a")))
    with pytest.raises(DataCheckError, match="invalid months"):
        check(frame.withColumn("month", F.lit(None).cast("date")))
    with pytest.raises(DataCheckError, match="repeats"):
        check(frame.unionByName(frame))
    with pytest.raises(DataCheckError, match="non-finite"):
        check(frame.withColumn("target", F.lit(float("inf"))))


def test_not_finite_on_a_wide_panel(spark):
    names = [f"f{i}" for i in range(400)]
    frame = spark.range(2).select("id", *[F.lit(1.0).alias(n) for n in names])
    assert checks.not_finite(frame, names).count() == 0
    assert checks.not_finite(frame.withColumn("f399", F.lit(float("nan"))), names).count() == 2
    assert checks.not_finite(frame, []).count() == 0
