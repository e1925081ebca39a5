"""Queries of this package against their SQL over the smallest generated tables."""

import pytest
from check_oracle import compare, oracle

from tillroll.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert compare(spark, oracle(SF), SF, name) is None
