"""Every registered query beside its SQL, on whole tables."""

import pytest

import __spark_entry__ as entry
from catalogspark.plans import registry
from compare import compare, oracle

registry.load()
QUERIES, SQL = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    problem, rows, _ = compare(spark, con, sf_dir, name, QUERIES[name], SQL.get(name))
    assert problem is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
