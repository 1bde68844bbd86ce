import pytest

from chainloom import registry
from tests.oracle import connect, difference

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    assert difference(spark, con, registry.QUERIES[name], registry.ORACLES[name], SMALL) == ""
