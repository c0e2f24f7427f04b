"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

from checks.compare import difference, duck
from checks.oracle import ORACLES
from checks.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, connection, name):
    found = QUERIES[name](spark, FOLDER).toPandas()
    expected = connection.execute(ORACLES[name]).fetchdf()
    assert len(found) > 0
    assert difference(found, expected) == ""
