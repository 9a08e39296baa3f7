"""A few catalog queries against their SQL; `check_oracles.py` runs all of them."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_every_oracle_has_a_query(spark):
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", ["lmer_count", "vertex_degrees", "successors", "scan_multi", "hash_slots", "spmv"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{file}')")
    want = con.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    key = lambda row: tuple((v is None, v) for v in row)
    got = sorted((tuple(r[c] for c in columns) for r in queries()[name](spark, SF).collect()), key=key)
    assert got == sorted(want.fetchall(), key=key)


def test_entry(spark):
    assert entry(spark).columns == ["contig", "part", "seq"]
