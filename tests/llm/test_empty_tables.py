"""The text queries over empty tables: no crash, and no rows but those of targets."""

import glob
import os

import pyarrow.parquet as pq
import pytest

from meridian.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    out = tmp_path_factory.mktemp("empty")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        files = sorted(glob.glob(f"{p}/*.parquet")) if os.path.isdir(p) else [p]
        pq.write_table(pq.read_table(files[0]).slice(0, 0), out / os.path.basename(p))
    return str(out)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, empty, name):
    df = QUERIES[name](spark, empty)
    assert df.collect() == [] and df.columns
