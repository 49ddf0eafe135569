"""Every registered query against its SQL on the smallest tables."""

import pytest
from conftest import SF_DIR
from oracle_check import compare, connect

import __spark_entry__ as entry
from roadstats.plans.oracle import ORACLE
from roadstats.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    n, diff = compare(spark, con, name, SF_DIR)
    assert n > 0
    assert not diff, "\n".join(diff)


def test_entry(spark):
    assert entry.entry(spark).columns == ["Municipio", "FasciaEta", "Sesso", "n", "pos"]
