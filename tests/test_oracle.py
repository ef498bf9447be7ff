"""Every registered query against its SQL, on the smallest sample."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle.statements import statements
from tallymatch.catalog import QUERIES
from tools.check_oracle import connect, difference

SAMPLE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SAMPLE)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(statements())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ours = entry.queries()[name](spark, SAMPLE).toArrow()
    theirs = duck.sql(entry.oracle_sql()[name]).to_arrow_table()
    assert difference(ours, theirs) is None
