"""The queries that SQL can express, against their SQL on whole tables."""

import pytest

from feedweave.llm.oracles import ORACLES
from feedweave.llm.queries import QUERIES
from workload.check import compare, duck


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(spark, duck(sf_dir), sf_dir, QUERIES[name], ORACLES[name]) is None
