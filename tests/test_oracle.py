"""Every registered query against its oracle at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import difference

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert difference(spark, FOLDER, QUERIES[name], ORACLES.get(name)) == ""
