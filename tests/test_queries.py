"""Every registered query runs, and gives the rows of its SQL where it has one."""

from __future__ import annotations

import pytest
from lodestone.queries import ORACLES, QUERIES
from oracle import connect, difference

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, db, name):
    rows = QUERIES[name](spark, SMALL)
    assert name in ORACLES, "each of these queries has SQL"
    assert not difference(rows, ORACLES[name], db)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["o_orderkey", "o_totalprice"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
