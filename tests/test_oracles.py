"""Every query with a SQL twin must give the same rows."""

import pytest
from oracle_check import connect, differences

import __spark_entry__ as entry_module
from monthloom.plans import catalogue, oracles

ROWS_ONLY = {"gbt_depthwise", "gbt_leafwise", "gbt_importance", "tuned_vs_benchmark"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_is_compared_or_listed():
    assert set(catalogue.all_queries()) - set(oracles.all_oracles()) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(oracles.all_oracles()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    frame = entry_module.queries()[name](spark, sf_dir)
    assert differences(frame, duck, entry_module.oracle_sql()[name])[:3] == []


def test_entry_has_rows(spark):
    rows = entry_module.entry(spark).collect()
    assert [r["rank"] for r in rows] == [1, 2, 3]
