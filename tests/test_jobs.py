"""The four jobs on hand-made files, from raw series to the comparison table."""

import json
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from monthloom.operators.boosting import BoostingSettings
from monthloom.operators.tuning import FloatRange, IntRange
from monthloom.params import RATE_DIMENSIONS, BreakRule
from monthloom.plans import jobs
from monthloom.sources import artifacts

N_MONTHS, ENTITIES = 66, {"AUS": "AU", "DEU": "DE", "USA": "US"}
SERIES = ("3", "7", "10001")


def month(i):
    return f"{2009 + i // 12}-{i % 12 + 1:02d}"


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    root = tmp_path_factory.mktemp("inputs")
    rng = random.Random(5)
    for code in [*ENTITIES.values(), "CN"]:
        for sid in (*SERIES, "10052"):
            values = [40 + 10 * math.sin(i / 5) + i / 4 + rng.uniform(-4, 4) for i in range(N_MONTHS)]
            values = [v * (1.5 if month(i) >= "2011-01" else 1) for i, v in enumerate(values)]
            body = "".join(f"{month(i)},{v:.1f}\n" for i, v in enumerate(values))
            (root / f"{sid}_{code}_m_all.csv").write_text("head\n\n" + body)
    lines = [",".join(["REF_AREA", *RATE_DIMENSIONS, "TIME_PERIOD", "OBS_VALUE"])]
    for area in ENTITIES:
        level = rng.uniform(4, 8)
        for i in range(N_MONTHS):
            level += rng.uniform(-0.2, 0.2)
            if (area, i) != ("DEU", 30):
                lines.append(",".join([area, *RATE_DIMENSIONS.values(), month(i), f"{level:.2f}"]))
    (root / "rates").mkdir()
    (root / "rates" / "rates.csv").write_text("\n".join(lines) + "\n")
    return root


@pytest.fixture(scope="module")
def panel_path(spark, inputs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("panel") / "panel")
    summary = jobs.build_panel(
        spark, str(inputs), str(inputs / "rates" / "rates.csv"), path,
        rule=BreakRule(category=("2011-01-01",), topic=("2011-01-01", "2013-01-01")),
    ).first()
    return path, summary


def test_panel_job(spark, panel_path):
    path, s = panel_path
    assert (s.n_files, s.n_excluded) == (16, 7)
    assert [(e.label, e.code, e.n_files) for e in s.excluded] == [("entity", "CN", 3), ("series", "10052", 4)]
    assert (s.n_entities, s.n_features, s.n_dummies) == (3, 3, 2)
    assert s.rows_dropped == 36 and s.n_panel_rows == 3 * (N_MONTHS - 12)
    assert (s.n_filled, s.n_unfilled) == (1, 0)
    assert s.filled_examples[0].entity == "DE"
    assert s.n_rows == 3 * (N_MONTHS - 13) and s.rows_without_target == 3
    panel = spark.read.parquet(path)
    assert {"C_DE", "C_US", "cat_3", "cat_7", "t_10001", "level_lag1", "target"} <= set(panel.columns)
    assert "level" not in panel.columns and "C_AU" not in panel.columns


def test_forecast_and_compare_jobs(spark, panel_path, tmp_path):
    path, _ = panel_path
    out = str(tmp_path / "out")
    jobs.forecast_baselines(spark, path, out, window=24, test_start="2014-04")
    settings = BoostingSettings(n_estimators=3, min_rows=3)
    paths = jobs.forecast_boosting(
        spark, path, out, settings, "depthwise", window=24, lag_count=1, test_start="2014-04"
    )
    weights = spark.read.parquet(paths["importance"])
    assert weights.agg(F.sum("mean_importance")).first()[0] == pytest.approx(1.0)
    assert weights.count() == 3 + 2 + 1 + 1
    assert len(artifacts.read_last_model(paths["model"]).stages) == 2
    tables = jobs.compare_models(spark, out, path, str(tmp_path / "tables"))
    rows = spark.read.parquet(tables["comparison"]).collect()
    assert {r.model for r in rows} == {"Random walk", "AR(1)", settings.model}
    assert {r.n for r in rows} == {9} and sorted(r["rank"] for r in rows) == [1, 2, 3]
    assert spark.read.parquet(tables["audit"]).count() == 27


def test_packed_panel_job(spark, inputs, panel_path, tmp_path):
    path, out = str(tmp_path / "packed"), str(tmp_path / "out")
    shape = jobs.build_packed_panel(
        spark, str(inputs), str(inputs / "rates" / "rates.csv"), path,
        rule=BreakRule(category=("2011-01-01",), topic=("2011-01-01", "2013-01-01")),
    ).first()
    wide = spark.read.parquet(panel_path[0])
    assert (shape.n_entities, shape.n_features, shape.n_rows) == (3, 3, wide.count())
    keys = ["entity", "month", "level_lag1", "target"]
    rows = spark.read.parquet(path)
    assert sorted(rows.select(*keys).collect()) == sorted(wide.select(*keys).collect())
    jobs.forecast_baselines(spark, path, out, window=24, test_start="2014-04")
    settings = BoostingSettings(n_estimators=2, min_rows=3)
    paths = jobs.forecast_boosting(spark, path, out, settings, "packed", window=24, test_start="2014-04")
    names = {r.feature for r in spark.read.parquet(paths["importance"]).collect()}
    assert names == {"cat_3", "cat_7", "t_10001", "C_DE", "C_US", "level_lag1", "target_lag1"}
    tables = jobs.compare_models(spark, out, path, str(tmp_path / "tables"))
    assert spark.read.parquet(tables["comparison"]).count() == 3


def test_baseline_test_start_beyond_the_panel(spark, panel_path, tmp_path):
    with pytest.raises(ValueError, match="No test month"):
        jobs.forecast_baselines(spark, panel_path[0], str(tmp_path), window=24, test_start="2030-01")


def test_tuning_job(spark, panel_path, tmp_path):
    path, _ = panel_path
    space = (IntRange("max_depth", 2, 3), FloatRange("learning_rate", 0.05, 0.2, log=True))
    paths = jobs.tune_boosting(
        spark, path, str(tmp_path), "depthwise", space,
        lambda t: BoostingSettings(n_estimators=2, max_depth=t["max_depth"], min_rows=3,
                                   learning_rate=t["learning_rate"]),
        n_trials=3, mode="exact", windows=[12, 24, 60], lag_options=[0, 1],
        validation_months=3, holdout_months=12, startup_trials=1, warmup_months=1,
    )
    part = next(Path(paths["result"]).glob("part-*.json"))
    result = json.loads(part.read_text())
    assert result["n_trials"] == 3 and result["n_complete"] + result["n_stopped"] == 3
    assert result["best_params"]["trial"] == result["best_trial"]
    assert result["tuning_end"] == "2013-06-30" and result["recommended_test_start"] == "2013-07-31"
    history = spark.read.parquet(paths["trials"])
    assert history.count() == 3 and history.filter("state is null").count() == 0
    best = history.filter("state = 'complete'").agg(F.min("value")).first()[0]
    assert result["best_rmse"] == pytest.approx(best)
