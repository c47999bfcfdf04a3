"""Every registered query of the core over the smallest tables, against its SQL where it has one."""

import glob
import os

import duckdb
import pytest

from meridian.plans import measures, panels, problems, reference
from verify import rows_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
PARTS = (problems, reference, measures, panels)
QUERIES = {k: q for p in PARTS for k, q in p.QUERIES.items()}
SQL = {k: q for p in PARTS for k, q in p.SQL.items()}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, FOLDER)
    got = df.collect()
    if name in SQL:
        want = tables.execute(SQL[name])
        columns = [d[0] for d in want.description]
        assert sorted(df.columns) == sorted(columns)
        assert rows_of(df.columns, got) == rows_of(columns, want.fetchall())
