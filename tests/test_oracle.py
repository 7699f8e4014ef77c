"""Every query equals its SQL on the smallest data, and none is empty."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from playbill.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    n, diff = compare(spark, con, FOLDER, QUERIES[name], ORACLES[name])
    assert diff == []
    assert n > 0 or name in {"view_tonight", "token_match", "f_combined", "top_k"}


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() == 50
