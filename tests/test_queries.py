"""Every registered query against its SQL on the given tables."""

import os

import pytest

from tests.oracle import database, difference
from tracewell.workload import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLES:
        assert difference(frame, con.execute(ORACLES[name]).df()) is None
    else:
        assert len(frame) > 0
