"""Every query with a SQL twin, compared with DuckDB on the smallest tables."""

import pytest
from compare import compare, views

from fraudloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, con, name):
    out = compare(spark, con, FOLDER, name, catalogue.QUERIES[name], catalogue.ORACLES[name])
    assert out.startswith("ok") and "types" not in out, out


@pytest.mark.parametrize("name", ["m6_isolation_forest"])
def test_queries_without_sql_give_rows(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0
