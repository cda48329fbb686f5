"""Every query with SQL gives DuckDB's rows on the test tables."""

import pytest

from ledgerlens.plans.registry import ORACLES, QUERIES

from .conftest import SF_TEST
from .duck import connection, same_rows


@pytest.fixture(scope="module")
def duck():
    return connection(SF_TEST)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF_TEST)
    if name not in ORACLES:
        assert found.count() > 0
        return
    same_rows(found.toPandas(), duck.sql(ORACLES[name]).df())
