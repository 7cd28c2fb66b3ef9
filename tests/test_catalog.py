"""Every registered query against its oracle, on the smallest tables."""
import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = oracle_sql()


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    ok, message, _, _ = compare(spark, name, queries()[name], ORACLES[name], SF)
    assert ok, message


def test_entry_has_rows(spark):
    assert entry(spark).limit(1).count() == 1
