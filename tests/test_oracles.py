"""Every registered query against its DuckDB oracle on the small fixture."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quarry.registry import all_oracles, all_queries  # noqa: E402
from tools.oracle_check import duck, rows_of  # noqa: E402

from .conftest import SF_SMALL  # noqa: E402

QUERIES = all_queries()
ORACLES = all_oracles()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    sdf = QUERIES[key](spark, SF_SMALL).toPandas()
    odf = con.execute(ORACLES[key]).df()
    sc, sr = rows_of(sdf)
    oc, orr = rows_of(odf)
    assert sc == oc
    assert len(sr) == len(orr)
    assert sr == orr


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
