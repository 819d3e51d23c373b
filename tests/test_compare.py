import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from monthloom.operators import compare, evaluate
from monthloom.operators.checks import DataCheckError
from monthloom.sources import artifacts, prediction_files

D = [dt.date(2020, 1, 31), dt.date(2020, 2, 29), dt.date(2020, 3, 31)]


def predictions(spark, rows):
    return spark.createDataFrame(
        rows, "month date, entity string, model string, actual double, prediction double"
    )


def two_models(spark):
    rows = [(d, "A", "m1", 1.0, 1.0 + i) for i, d in enumerate(D)]
    rows += [(d, "A", "m2", 1.0, 1.0 - i) for i, d in enumerate(D[:2])]
    return predictions(spark, rows)


def test_metrics(spark):
    rows = [(D[0], "A", "m", 1.0, 0.0), (D[1], "A", "m", 3.0, 3.0), (D[0], "B", "m", 2.0, 4.0)]
    frame = predictions(spark, rows)
    r = evaluate.metrics_overall(frame).first()
    assert (r.mae, r.n) == (1.0, 3)
    assert r.rmse == pytest.approx(math.sqrt(5 / 3))
    assert r.r2 == pytest.approx(1 - 5 / 2)
    by = {x.entity: x for x in evaluate.metrics_by_entity(frame).collect()}
    assert by["B"].r2 is None and by["A"].r2 == pytest.approx(1 - 1 / 2)
    both = evaluate.metrics_all(frame)
    assert both.filter("overall = 1").count() == 1 and both.filter("overall = 0").count() == 2


def test_r2_of_constant_actuals(spark):
    exact = predictions(spark, [(d, "A", "m", 2.0, 2.0) for d in D])
    off = predictions(spark, [(d, "A", "m", 2.0, 1.0) for d in D])
    assert evaluate.metrics_overall(exact).first().r2 == 1.0
    assert evaluate.metrics_overall(off).first().r2 == 0.0


def test_common_sample(spark):
    common = compare.checked_common_sample(two_models(spark))
    assert {(r.month, r.model) for r in common.collect()} == {(d, m) for d in D[:2] for m in ("m1", "m2")}
    widest = compare.widest_spread(common).first()
    assert widest.spread == 0.0


def test_common_sample_errors(spark):
    frame = two_models(spark)
    with pytest.raises(DataCheckError, match="at least two models"):
        compare.checked_common_sample(frame.filter("model = 'm1'"))
    with pytest.raises(DataCheckError, match="two predictions"):
        compare.checked_common_sample(frame.unionByName(frame))
    apart = predictions(spark, [(D[0], "A", "m1", 1.0, 1.0), (D[1], "A", "m2", 1.0, 1.0)])
    with pytest.raises(DataCheckError, match="share no entity"):
        compare.checked_common_sample(apart)
    other = frame.withColumn("actual", F.expr("if(model = 'm2', 1.5, actual)"))
    with pytest.raises(DataCheckError, match="disagree on the outcome"):
        compare.checked_common_sample(other)


def panel(spark):
    return spark.createDataFrame(
        [(d, "A", 5.0, 1.0) for d in D], "month date, entity string, level_lag1 double, target double"
    )


def test_levels_and_ranks(spark):
    rows = [(d, "A", m, 1.0, p) for d in D for m, p in (("x", 2.0), ("y", 0.0), ("z", 4.0))]
    levels = compare.attach_levels(predictions(spark, rows), panel(spark))
    compare.check_levels(levels)
    ranked = compare.ranking(compare.level_metrics(levels)).collect()
    assert [(r["rank"], r.model) for r in ranked] == [(1, "x"), (1, "y"), (3, "z")]
    assert ranked[0].mape == pytest.approx(1 / 6) and ranked[2].mape == pytest.approx(3 / 6)
    audit = compare.prediction_audit(levels, compare.ranking(compare.level_metrics(levels)))
    first = audit.first()
    assert len(audit.columns) == 11
    assert (first.model, first.actual_level, first.prediction_level) == ("x", 6.0, 7.0)
    shown = {r.metric: r.value for r in compare.plot_metrics(compare.ranking(compare.level_metrics(levels))).filter("model = 'z'").collect()}
    assert shown["mape"] == pytest.approx(50.0)


def test_level_checks(spark):
    frame = predictions(spark, [(D[0], "A", "m", 1.0, 1.0)])
    with pytest.raises(DataCheckError, match="no panel row"):
        compare.check_levels(compare.attach_levels(frame, panel(spark).filter("entity = 'B'")))
    with pytest.raises(DataCheckError, match="differs from the panel"):
        compare.check_levels(compare.attach_levels(frame, panel(spark).withColumn("target", F.lit(1.1))))
    with pytest.raises(DataCheckError, match="positive levels"):
        compare.check_levels(compare.attach_levels(frame, panel(spark).withColumn("level_lag1", F.lit(-1.0))))


def test_plot_series(spark):
    levels = compare.attach_levels(predictions(spark, [(d, "A", "m", 1.0, 2.0 + i) for i, d in enumerate(D)]), panel(spark))
    rows = compare.plot_series(levels, ["A"]).collect()
    assert {(r.axis_low, r.axis_high) for r in rows} == {(5.75, 9.25)}
    with pytest.raises(DataCheckError, match="No common-sample predictions for \\['Z'\\]"):
        compare.check_plot_series(levels, ["A", "Z"])
    compare.check_plot_series(levels, ["A"])


def test_prediction_files(spark, tmp_path):
    base = two_models(spark).withColumn("train_start", F.col("month")).withColumn("train_end", F.col("month"))
    folder = str(tmp_path)
    for model in ("m1", "m2"):
        paths = prediction_files.save_evaluation(base.filter(F.col("model") == model), folder, model)
    assert spark.read.parquet(paths["overall_metrics"]).count() == 1
    rows = prediction_files.load_predictions(spark, folder)
    assert rows.count() == 5 and rows.select("source_file").distinct().count() >= 2
    bad = base.withColumn("prediction", F.lit(float("nan")))
    prediction_files.save_evaluation(bad, folder, "m3")
    with pytest.raises(DataCheckError, match="non-finite"):
        prediction_files.load_predictions(spark, folder)


def test_prediction_csv(spark, tmp_path):
    head = ("month,entity,model,actual,prediction,train_start,train_end,error,absolute_error,"
            "squared_error\n")
    line = "2020-01-31,A,m,1.0,0.5,2019-01-31,2019-12-31,0.5,0.5,0.25\n"
    (tmp_path / "sub").mkdir()
    (tmp_path / "a_predictions.csv").write_text(head + line)
    (tmp_path / "sub" / "b_predictions.csv").write_text(head + line.replace(",m,", ",k,"))
    (tmp_path / "other.csv").write_text("junk\n")
    (tmp_path / "d_predictions.csv").write_text("note,prediction,actual,model,entity,month\nx,1,2,o,A,2020-01-31\n")
    rows = prediction_files.checked_predictions(prediction_files.read_prediction_csv(spark, str(tmp_path)))
    assert sorted((r.model, r.prediction) for r in rows.collect()) == [("k", 0.5), ("m", 0.5), ("o", 1.0)]
    (tmp_path / "c_predictions.csv").write_text(head + line.replace("2020-01-31", "soon", 1))
    with pytest.raises(Exception, match="MALFORMED|soon"):
        prediction_files.read_prediction_csv(spark, str(tmp_path)).collect()
    (tmp_path / "c_predictions.csv").write_text("month,entity,model,actual\n")
    with pytest.raises(DataCheckError, match="lack the columns.*prediction"):
        prediction_files.read_prediction_csv(spark, str(tmp_path))


def test_comparison_tables(spark, tmp_path):
    rows = [(d, "A", m, 1.0, p) for d in D for m, p in (("x", 3.0), ("y", 2.0))]
    levels = compare.attach_levels(predictions(spark, rows), panel(spark))
    paths = artifacts.write_comparison(levels, compare.ranking(compare.level_metrics(levels)), str(tmp_path))
    assert spark.read.parquet(paths["comparison"]).count() == 2
    assert [r.model for r in spark.read.parquet(paths["audit"]).collect()] == ["y"] * 3 + ["x"] * 3
