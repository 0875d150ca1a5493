"""The queries that SQL can express against DuckDB, over whole tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from tessera.llm.queries import ORACLES, QUERIES

DATA = os.environ.get("TESSERA_ORACLE_DATA", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    found = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})").fetchall()
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    assert got == sorted(found, key=repr)
