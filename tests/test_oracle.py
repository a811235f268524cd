"""Every registered query with a SQL counterpart, side by side at a small scale."""

import os

import pytest
from compare import compare, duck

from daymark.catalog import load_all

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
QUERIES = {n: q for n, q in load_all().items() if q.sql is not None}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    assert compare(QUERIES[name], spark, con, SF_DIR) is None


def test_inventory_is_covered():
    """Every operator ID of the inventory has at least one query."""
    have = {n.split("_")[0] for n in load_all()}
    spans = {"s": 12, "q": 17, "f": 15, "v": 10, "m": 13, "e": 14, "a": 24, "x": 17, "i": 11, "t": 3}
    missing = [f"{k}{i}" for k, top in spans.items() for i in range(1, top + 1)
               if f"{k}{i}" not in have]
    assert not missing
