"""Packed panels: equal to wide ones, with plans that do not grow with the features."""

import datetime as dt
import random
import time

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from monthloom.operators import boosting, packed, panel
from monthloom.operators.boosting import BoostingSettings
from monthloom.operators.checks import DataCheckError
from monthloom.sources import panel_store


def long_frame(spark, n_features, entities="CBA", months=14):
    rng = random.Random(3)
    cells = [
        (e, f"f{k:03d}", dt.date(2020 + m // 12, m % 12 + 1, 1), rng.random())
        for e in entities for k in range(n_features) for m in range(months)
    ]
    cells = [c if c[:3] != ("B", "f001", dt.date(2020, 2, 1)) else (*c[:3], float("nan")) for c in cells]
    return spark.createDataFrame(cells, "entity string, feature string, month date, value double")


def test_packed_and_wide_hold_the_same(spark):
    long = long_frame(spark, 4)
    dictionary = packed.feature_dictionary(long)
    assert [tuple(r) for r in dictionary.orderBy("position").collect()] == [(k, f"f{k:03d}") for k in range(4)]
    rows = packed.pack_panel(long, dictionary)
    names = panel.feature_names(long)
    wide = panel.balanced_panel(long, names, ["A", "B", "C"], "B")
    assert rows.count() == 3 * 14 - 1
    again = packed.wide(rows, dictionary, names)
    assert sorted(again.select("month", "entity", *names).collect()) == sorted(wide.select("month", "entity", *names).collect())
    entities = packed.entity_dictionary(rows, "B")
    assert [r.entity for r in entities.orderBy("position").collect()] == ["B", "A", "C"]
    design = packed.design(rows, entities, [])
    places = [r.feature for r in packed.design_names(dictionary, entities, []).orderBy("position").collect()]
    assert places == [*names, "C_A", "C_C"]
    found = {(r.entity, r.month): tuple(r.v) for r in design.select("entity", "month", vector_to_array("features_vec").alias("v")).collect()}
    assert found == {(r.entity, r.month): tuple(float(r[c]) for c in places) for r in wide.collect()}
    with pytest.raises(ValueError, match="lacks.*nope"):
        packed.wide(rows, dictionary, ["nope"])


def test_store_and_rules(spark, tmp_path):
    long = long_frame(spark, 3)
    dictionary = packed.feature_dictionary(long)
    rows = packed.pack_panel(long, dictionary).withColumns({"level_lag1": F.lit(5.0), "target": F.rand(1)})
    path = str(tmp_path / "panel")
    panel_store.write_checked(rows, path, packed.packed_rules(dictionary))
    panel_store.write_dictionaries(dictionary, packed.entity_dictionary(rows, "A"), path)
    loaded, features = panel_store.load_panel(spark, path)
    assert features == ["features", "level_lag1"] and loaded.count() == rows.count()
    kept, entities = panel_store.read_dictionaries(spark, path)
    assert kept.count() == 3 and entities.where("position = 0").first().entity == "A"
    longer = rows.withColumn("features", F.when(F.month("month") == 3, F.array_append("features", F.lit(1.0))).otherwise(F.col("features")))
    with pytest.raises(DataCheckError, match="not one value per feature"):
        panel_store.write_checked(longer, str(tmp_path / "b"), packed.packed_rules(dictionary))
    holes = rows.withColumn("features", F.transform("features", lambda x: F.when(x > 0.5, x)))
    holes.write.parquet(str(tmp_path / "c"))
    with pytest.raises(DataCheckError, match="non-finite features"):
        panel_store.load_panel(spark, str(tmp_path / "c"))


def test_fits_on_arrays_equal_fits_on_columns(spark, tmp_path):
    long = long_frame(spark, 2, entities="ABCD")
    dictionary = packed.feature_dictionary(long)
    outcome = F.round(F.rand(4) * 9)
    rows = packed.pack_panel(long, dictionary).repartition(1).withColumn("target", outcome)
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    settings = BoostingSettings(n_estimators=3, min_rows=1, subsample=1.0, column_fraction=1.0)
    entities = packed.entity_dictionary(rows, "A")
    arrays = boosting.rolling_boosting(boosting.prepare_packed(rows, dictionary, entities), 12, settings)
    names = [r.feature for r in packed.design_names(dictionary, entities, []).orderBy("position").collect()]
    wide = packed.wide(rows, dictionary, names[:2]).withColumns({n: (F.col("entity") == n[2:]).cast("int") for n in names[2:]})
    columns = boosting.rolling_boosting(boosting.prepare(wide, names), 12, settings)
    take = lambda r: sorted((x.entity, x.month, round(x.prediction, 9)) for x in r.predictions.collect())
    assert take(arrays) == take(columns)
    share = lambda r: sorted((x.test_idx, x.feature, round(x.importance, 9)) for x in r.importances.collect())
    assert share(arrays) == share(columns)


def test_a_hundred_thousand_features_plan_in_seconds(spark):
    cells = spark.range(200_000).select(
        F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("entity"),
        F.concat(F.lit("f"), (F.col("id") / 2).cast("long").cast("string")).alias("feature"),
        F.lit(dt.date(2020, 1, 1)).alias("month"),
        F.col("id").cast("double").alias("value"),
    )
    begin = time.perf_counter()
    dictionary = packed.feature_dictionary(cells)
    rows = packed.design(packed.pack_panel(cells, dictionary), packed.entity_dictionary(cells, "A"), [])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert time.perf_counter() - begin < 20 and len(plan) < 60_000
    sizes = rows.select("entity", F.size(vector_to_array("features_vec")).alias("n")).collect()
    assert {(r.entity, r.n) for r in sizes} == {("A", 100_001), ("B", 100_001)}
