"""Every registered query against its SQL."""

import pytest
from check_queries import compare, connect

from feedmill.registry import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    compare(spark, connect(SF_DIR), SF_DIR, name)
