"""Every registered query against its expected result, at the smallest scale."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from varscope.plans.oracle import ORACLES
from varscope.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_every_query_has_an_expected_result():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r.exit_code for r in rows} == {0, 1}
    assert {1, 2} <= {r.strict_exit_code for r in rows}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert differences(spark, duck, name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR) == []
