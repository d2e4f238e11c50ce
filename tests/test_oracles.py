"""Every query against its SQL on the smallest tables; those without SQL must run and keep a stable schema."""

import pytest

from loomspan.plans import ORACLES, QUERIES
from loomspan.testing import difference, duck
from tests.conftest import SF


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, connection, name):
    assert difference(QUERIES[name](spark, SF), ORACLES[name], connection) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.schema == QUERIES[name](spark, SF).schema
    df.write.format("noop").mode("overwrite").save()
