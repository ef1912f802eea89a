"""Every registered query runs; where plain SQL exists both results are equal."""

import pytest

from tests.compare import difference
from tidewire.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        assert difference(spark, FOLDER, QUERIES[name], ORACLES[name]) is None
    else:
        QUERIES[name](spark, FOLDER).collect()


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
