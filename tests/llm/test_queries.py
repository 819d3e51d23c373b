"""The registered queries: SQL twins, whole tables, recall on the given data."""

import pytest
from oracle_check import connect, differences

import __spark_entry__ as entry_module
from monthloom.llm import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    frame = registry.QUERIES[name](spark, SMALL)
    assert differences(frame, connect(SMALL), registry.ORACLES[name])[:3] == []


def test_every_operator_is_registered():
    names = list(entry_module.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert "pipeline" in names
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_language_query_on_documents_it_has_not_seen(spark):
    rows = registry.QUERIES["op4_segmentation_language_id"](spark, "/root/testdata/sf0.01").where("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = rows.join(truth, "doc_id").selectExpr("avg(cast(lang = lang_pred as double))").first()[0]
    assert right > 0.97


def test_interpolation_beats_single_words_on_held_out_texts(spark):
    rows = registry.QUERIES["op10_deleted_interpolation"](spark, "/root/testdata/sf0.01").where("held_out")
    score, base = rows.selectExpr("sum(score)", "sum(base_score)").first()
    assert score > base


def test_quality_query_agrees_with_labels(spark):
    rows = registry.QUERIES["op1_divergence_quality"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = {
        (r.quality, r.kept): r["count"]
        for r in rows.where("n_words >= 20").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    }
    assert found.get((1, False), 0) <= 0.02 * found[1, True]
    assert found.get((0, True), 0) <= 0.05 * found[0, False]
