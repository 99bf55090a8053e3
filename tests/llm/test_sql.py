"""Corpus queries with SQL give its rows."""

from __future__ import annotations

import pytest
from lodestone.llm.queries import ORACLES, QUERIES
from oracle import connect, difference

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert not difference(QUERIES[name](spark, SMALL), ORACLES[name], connect(SMALL))
