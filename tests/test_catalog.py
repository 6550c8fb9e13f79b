"""Every query with SQL against DuckDB over the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
import tools_compare
from pairsight.plans.catalog import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for t in tools_compare.TABLES:
        if glob.glob(f"{SF}/{t}.parquet"):
            found.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return found


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal(spark, con, name):
    assert tools_compare.compare(spark, con, SF, name).startswith("equal")


def test_entry(spark):
    if os.path.isdir(SF):
        assert entry.entry(spark).count() > 0
