"""Every registered query against its SQL on the smallest data."""

import pytest

from millrace.queries import ORACLE_SQL, QUERIES

from .helpers import assert_same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    assert_same(QUERIES[name](spark, sf), duck, ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
