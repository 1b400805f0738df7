"""Every registered query beside its SQL on the smallest tables."""

import pytest
from check_oracle import compare, duck

from caseloom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    out, _ = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert out.startswith(("ok", "rows-only")), out
