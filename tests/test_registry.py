"""Every registered query against its SQL twin, on the smallest tables."""

import compare
import pytest

from mapgauge.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLES:
        compare.check(df, registry.ORACLES[name], SF)
    else:
        assert df.count() == 1
