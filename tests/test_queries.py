"""Every registered query against its DuckDB twin, at the smallest scale."""

import pytest

import __spark_entry__ as registry
from corpusloom.catalog.oracle import ORACLE
from corpusloom.catalog.queries import QUERIES
from oracle_check import compare, connect


@pytest.fixture(scope="module")
def database(sf_dir):
    return connect(sf_dir)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(registry.queries()) and set(ORACLE) <= set(registry.oracle_sql())
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_twin(spark, database, sf_dir, name):
    assert compare(spark, database, name, QUERIES[name], ORACLE[name], sf_dir) is None


def test_entry(spark):
    rows = registry.entry(spark).collect()
    assert rows and all(r.components > 0 for r in rows)


def test_diagrams_are_judged_by_the_whole_text(spark, tmp_path):
    texts = [(1, "x " * 60 + "`graph`"), (5, "x " * 60), (9, "pie"), (2, "graph"), (3, "x " * 60)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["diagram_validity"](spark, str(tmp_path)).collect()
    assert sorted((r.file_id, r.is_valid) for r in found) == [(1, True), (3, True), (5, False), (9, True)]
