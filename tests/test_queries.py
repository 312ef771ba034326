"""Every registered query with SQL, against that SQL on the same tables."""

from __future__ import annotations

import os

import pytest

from pastward.catalog import LONG, ORACLES, QUERIES
from tests.oracle import connect, difference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - set(LONG)))
def test_equals_sql(spark, con, name):
    assert difference(spark, con, name, FOLDER) is None


def test_statements_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
