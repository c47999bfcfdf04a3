import glob
import os

import duckdb
import pytest

from meridian.plans import reference

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_all_families(spark):
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    want = con.execute("""
with a as (select x.cik, c.family, min(x.unit) u from fundamental_facts x join concept_families c using (taxonomy, concept) group by 1, 2),
r as (select cik, family, min(unit) u from concept_resolution group by 1, 2)
select coalesce(a.cik, r.cik), coalesce(a.family, r.family), case when r.cik is null then 'added' when a.cik is null then 'removed' else 'changed' end
from a full join r on a.cik = r.cik and a.family = r.family where r.cik is null or a.cik is null or a.u is distinct from r.u""").fetchall()
    got = [(r.cik, r.family, r.change) for r in reference.drift_of_family_units(spark, FOLDER).collect()]
    assert sorted(got) == sorted(want) and len({f for _, f, _ in got}) > 1
