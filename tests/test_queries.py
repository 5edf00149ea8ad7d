"""Every query against its DuckDB SQL, on the smallest tables."""

import os

import pytest

from corpusloom import catalog
from tests.oracle import differences

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, DIR)
    if name in catalog.ORACLES:
        assert not differences(df, catalog.ORACLES[name], DIR)
        assert df.limit(1).count(), "an empty result shows nothing"
    else:
        assert df.count() > 0
