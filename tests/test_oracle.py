"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from checks.compare import database, differences
from checks.oracle import ORACLE, sql
from checks.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, name):
    assert differences(QUERIES[name](spark, SF).toPandas(), database(SF).execute(sql(name)).df()) is None
