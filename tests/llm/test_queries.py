"""The registered queries: names, and those that SQL can express against their SQL."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from tallymatch.llm.queries import QUERIES, SQL
from tools.check_oracle import connect, difference

SAMPLE = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    ours = entry.queries()[name](spark, SAMPLE).toArrow()
    theirs = connect(SAMPLE).sql(SQL[name]).to_arrow_table()
    assert difference(ours, theirs) is None
