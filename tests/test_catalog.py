"""Every registered query against its SQL; queries without SQL have to give rows."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_DIR
from tests.oracle import compare, duck

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).limit(1).count() == 1


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["horizon"] for r in rows} == {24, 48, 60, 72}
    assert all(0 <= r["n_positive"] <= r["n_test"] for r in rows)


def test_names_match():
    assert set(ORACLES) <= set(QUERIES)
