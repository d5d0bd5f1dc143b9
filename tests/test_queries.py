"""Every registered query of the engine against its SQL, over whole tables."""

import pytest

from ledgerleaf import registry

from .oracle import assert_same, connection

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLES:
        assert_same(got, connection(SF).execute(registry.ORACLES[name]).fetchdf())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
