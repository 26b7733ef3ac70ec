import os

import pytest

import __spark_entry__
from lodestar.plans.oracles import ORACLES
from lodestar.plans.registry import QUERIES
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, connection, name):
    assert differences(QUERIES[name](spark, FOLDER), connection, ORACLES[name]) is None


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["uid", "x", "y", "dist"]
