"""Queries against their SQL where keys are so large that sizes pass every unit."""

import os

import duckdb
import pytest

from lanternfish.plans import registry
from tests.conftest import SF, TABLES, same_rows


@pytest.fixture(scope="module")
def large_keys(tmp_path_factory):
    """The smallest tables, with orders whose keys are shifted far up."""
    folder, con = tmp_path_factory.mktemp("large"), duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if t == "orders":
            con.execute(f"COPY (SELECT * REPLACE (o_orderkey * 6001 AS o_orderkey, (o_custkey + 1) * 120000017 AS o_custkey) FROM '{SF}/{t}.parquet') TO '{folder}/{t}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f"{SF}/{t}.parquet", folder / f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["scalar_functions", "space_report"])
def test_large_sizes_match_sql(spark, large_keys, name):
    folder, con = large_keys
    same_rows(registry.queries()[name](spark, folder), con.execute(registry.oracle_sql()[name]))
