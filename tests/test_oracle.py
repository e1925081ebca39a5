"""Every registered query against its SQL over the smallest generated tables."""

import pytest
from check_oracle import compare, oracle

from tillroll.plans.oracles import ORACLES
from tillroll.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
# The fixed product of these two does not occur in the smallest tables.
EMPTY_HERE = {"price_history", "price_summary"}


@pytest.fixture(scope="module")
def db():
    return oracle(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    problem = compare(spark, db, SF, name)
    assert problem is None or (name in EMPTY_HERE and problem == "both empty"), problem
