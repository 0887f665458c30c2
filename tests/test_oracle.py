"""Every registered query against its DuckDB oracle on the smallest tables."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "scripts"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
# the catalog's own queries; the optional corpus queries have tests of their own
ORACLES = E.ORACLES
NAMES = sorted(n for n in E.QUERIES if n in ORACLES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], ORACLES[name], SF)
    assert r["cols"], r
    assert r["rows"] == r["oracle_rows"], r
    assert r["values"], r


def test_every_query_has_an_oracle_or_is_rows_only(spark):
    rows_only = set(E.QUERIES) - set(ORACLES)
    assert rows_only == {"lifecycle_closure", "command_path"}  # held against other engines in test_closure and test_loop


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "type" in df.columns
