"""Every query with an SQL twin gives the same rows on the smallest tables; the rest run."""

import os

import pytest

import __spark_entry__ as entry
from pagetrail.verify import compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


#: Queries that may have no row on the smallest tables.
MAY_BE_EMPTY = set()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    if name in SQL:
        assert compare(spark, QUERIES[name], SQL[name], SF) in ("", "both empty")
    else:
        rows = QUERIES[name](spark, SF).collect()
        assert rows or name in MAY_BE_EMPTY
        assert len({repr(r) for r in rows}) == len(rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(SQL) <= set(QUERIES)
