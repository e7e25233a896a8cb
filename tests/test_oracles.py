"""Every registered query of the engine against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessera.plans.registry import COVERS, ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return con


def plain(x):
    if x is None or isinstance(x, bool):
        return x
    if hasattr(x, "__float__"):
        return None if x != x else round(float(x), 5)
    return str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(([plain(v) for v in r] for r in df.select(columns).collect()), key=repr)
    assert COVERS[name]
    if name in ORACLES:
        twin = duck.sql(ORACLES[name])
        assert sorted(twin.columns) == columns
        picked = ", ".join(f'"{c}"' for c in columns)
        assert rows == sorted(([plain(v) for v in r] for r in duck.sql(f"SELECT {picked} FROM ({ORACLES[name]}) x").fetchall()), key=repr)
