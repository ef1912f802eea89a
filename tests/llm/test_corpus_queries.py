"""Registered corpus queries against SQL where SQL can express them."""

import pytest

from tests.compare import difference
from tidewire.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert difference(spark, FOLDER, QUERIES[name], ORACLES[name]) is None


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
