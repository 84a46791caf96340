"""Every query of the engine against its SQL, on the smallest tables."""

import os

import pytest

from tessera.plans import catalog
from tests.oracle import connect, difference

SF = os.environ.get("TESSERA_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    assert difference(spark, con, SF, catalog.queries()[name], catalog.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
