"""Every registered query against its SQL, over the smallest tables."""

import re

import pytest

import __spark_entry__ as entry
from checks.compare import compare, oracle_connection

SF = "/root/testdata/sf0.001"
#: The corpus operators have tests of their own.
OWN = re.compile(r"op\d+_|pipeline")
QUERIES = {name: query for name, query in entry.queries().items() if not OWN.match(name)}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if not OWN.match(name)}


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"findings_json"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert compare(con, name, QUERIES[name](spark, SF), ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert [r["step"] for r in rows] == ["Session Start", "View Products", "Add to Cart", "Begin Checkout", "Purchase"]
