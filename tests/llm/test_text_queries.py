"""The text queries over the smallest tables, against their SQL where they have one."""

import glob
import os

import duckdb
import pytest

from meridian.llm.queries import QUERIES, SQL
from verify import rows_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


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


def test_documents_each_have_a_row(spark):
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").distinct().count()
    assert QUERIES["p8_ids"](spark, FOLDER).count() == QUERIES["p9_copies"](spark, FOLDER).count() == QUERIES["p10_scores"](spark, FOLDER).count() == n
