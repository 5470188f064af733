"""Queries of the llm package against their SQL, and results that do not depend on the plan."""

import pytest
from compare import compare, duck

from datawarden.llm import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_sql(name, spark, sf_dir, con):
    assert compare(registry.QUERIES[name](spark, sf_dir), con, registry.ORACLE[name]) == []


@pytest.mark.parametrize("name", ["op4_jaccard_join", "op6_language_id", "op8_license_scan"])
def test_partitioning_does_not_matter(name, spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    rounded = lambda rows: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    run = registry.QUERIES[name]
    assert rounded(run(spark, sf_dir).collect()) == rounded(run(spark, str(tmp_path)).collect())
