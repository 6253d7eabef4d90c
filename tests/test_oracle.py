from __future__ import annotations

import pytest

from checks.compare import difference, oracle_connection
from checks.oracle import all_sql
from checks.queries import all_queries
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SMALL)


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, oracle, name):
    df = all_queries()[name](spark, SMALL)
    found = oracle.sql(all_sql()[name])
    assert difference(df.columns, [tuple(r) for r in df.collect()], list(found.columns), found.fetchall()) is None
