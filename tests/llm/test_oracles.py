"""Queries of the subpackage that SQL can express, beside their SQL on the smallest tables."""

import pytest
from check_oracle import compare, duck

from caseloom.llm.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    out, _ = compare(spark, duck(SF), SF, name, QUERIES[name], ORACLES[name])
    assert out.startswith("ok"), out
