"""Registered queries against SQL on the smallest data."""

import pytest

from millrace.llm.queries import ORACLE_SQL, QUERIES
from tests.helpers import assert_same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf, duck, name):
    assert_same(QUERIES[name](spark, sf), duck, ORACLE_SQL[name])
