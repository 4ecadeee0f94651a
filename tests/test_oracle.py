"""Every registered query against its SQL."""

import pytest

from workload.check import compare, duck
from workload.queries import all_oracles, all_queries


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql():
    assert set(all_oracles()) == set(all_queries())


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_equals_sql(spark, connection, sf_dir, name):
    assert compare(spark, connection, sf_dir, all_queries()[name], all_oracles()[name]) is None
