"""Every registered query against its SQL counterpart."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry_point
from datawarden.plans.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_a_counterpart():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLE[name]) == []


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["dataset_id", "quality_score", "trust_score", "value_score", "recommendation"]
    assert df.count() > 0
