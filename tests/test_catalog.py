"""Every image-graph query against its SQL on DuckDB."""

import glob
import os

import duckdb
import pytest

from tessgraph.plans.catalog_more import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    return sorted(tuple(round(float(x), 5) if isinstance(x, float) or hasattr(x, "as_tuple") else x for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, db, name):
    got = QUERIES[name](spark, DIR)
    cols = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert plain(map(tuple, got.select(*cols).collect())) == plain(want)
