"""The queries on repeated lines make the clusters and dates of filings only where these have an effect on the rows."""

from datetime import date

import duckdb
import pytest

from meridian.llm.boilerplate import lines_in_documents
from meridian.llm.queries import QUERIES, SQL
from verify import rows_of

#: Texts of each filing: a notice in six different filings, one filing delivered six times, a line in four filings alone.
FILINGS = (
    [(1, f"n{i}", i + 1, [f"about {'y' * (i + 1)}", f"notice of {i} days", f"more {'z' * (i + 1)}"]) for i in range(6)]
    + [(2, f"c{i}", 1, ["same article", "its end"]) for i in range(6)]
    + [(3, f"f{i}", i + 1, ["in four alone", f"own {'x' * (i + 1)}"]) for i in range(4)]
)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("filings")
    at, texts = {}, []
    for cik, a, day, lines in FILINGS:
        for p, t in enumerate(lines):
            at.setdefault(t, []).append((cik, a, date(2020, 1, day), "A", p))
            texts.append((a, "A", p, t))
    canonical = spark.createDataFrame(
        [*at.items(), *list(at.items())[:3], (None, [(1, "n0", date(2020, 1, 1), "A", 9)])],
        "normalized_text string, occurrences array<struct<cik:long,accession_number:string,filing_date:date,section_type:string,position:int>>",
    )
    canonical.write.parquet(str(out / "canonical_paragraphs.parquet"))
    spark.createDataFrame(texts, "accession_number string, section_type string, position int, text string").write.parquet(str(out / "paragraph_occurrences.parquet"))
    return str(out)


@pytest.fixture(scope="module")
def tables(folder):
    con = duckdb.connect()
    for name in ("canonical_paragraphs", "paragraph_occurrences"):
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("name", ["p2_found", "p2_sections", "p2_lines", "p2_boilerplate"])
def test_against_sql(spark, folder, tables, name):
    df = QUERIES[name](spark, folder)
    want = tables.execute(SQL[name])
    columns = [d[0] for d in want.description]
    got = rows_of(df.columns, df.collect())
    assert got and got == rows_of(columns, want.fetchall())


def test_copies_of_a_filing_count_as_filings_in_p2_found_alone(spark, folder):
    found = {(r.accession_number, r.position) for r in QUERIES["p2_found"](spark, folder).collect()}
    assert found == {(f"n{i}", 1) for i in range(6)} | {(f"c{i}", p) for i in range(6) for p in range(2)}
    assert [(r.cik, r.n_documents, r.n_clusters, r.n_dates) for r in QUERIES["p2_boilerplate"](spark, folder).collect()] == [(1, 6, 6, 6)]


@pytest.mark.parametrize("name, made", [("p2_found", False), ("p2_sections", False), ("p2_lines", True), ("p2_boilerplate", True)])
def test_clusters_and_dates_are_made_where_they_have_an_effect(spark, folder, name, made):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert ("bit_xor" in plan) == made and ("filing_date AS published" in plan) == made


def test_lines_in_documents(spark):
    schema = "source long, document string, published date, section string, position int, key string"
    rows = [(1, "a", date(2020, 1, 1), "A", 0, "k"), (1, "a", date(2020, 1, 2), "A", 0, "k"), (1, "a", None, "B", 1, "k"), (1, "b", None, "A", 0, "k")]
    rows += [(2, "c", None, "A", 0, "k"), (None, "d", None, "A", 0, "k"), (None, "e", None, "A", 0, "k"), (1, "f", None, "A", 0, None), (1, None, None, "A", 0, "k")]
    got = lines_in_documents(spark.createDataFrame(rows, schema), min_documents=2).collect()
    assert sorted((r.document, r.section, r.position, r.n_documents) for r in got) == [("a", "A", 0, 2), ("a", "B", 1, 2), ("b", "A", 0, 2), ("d", "A", 0, 2), ("e", "A", 0, 2)]
