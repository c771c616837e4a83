"""Every registered query with SQL, against that SQL."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, connection, name):
    assert compare(spark, connection, entry.queries()[name], SQL[name], SF_DIR).startswith("ok")


@pytest.mark.parametrize("name", ["i4_logistic_regression", "i18_kmeans", "i19_embed_texts", "i11_score"])
def test_model_query_runs(spark, name):
    assert entry.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["room_type", "count"] and rows.count() == 5


def test_registry():
    assert set(SQL) <= set(entry.queries())
