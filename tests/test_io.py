import json

import pytest
from pyspark.sql import functions as F

from meridian.sources import readers, sinks
from meridian.streaming import journal


def put(path, text):
    path.write_text(text)
    return str(path)


def test_company_facts(spark, tmp_path):
    occ = lambda end, val, accn, **k: {"end": end, "val": val, "accn": accn, "fy": 2020, "fp": "Q1", "form": "10-Q", "filed": "2020-05-01", **k}
    body = {"cik": 7, "entityName": "x", "facts": {"us-gaap": {"Assets": {"units": {"USD": [occ("2020-03-31", 5, "a"), occ("2020-03-31", 5, "b")], "CAD": [occ("bad", 1, "c")]}}}, "dei": {"Shares": {"units": {"shares": [occ("2020-03-31", 9, "a", start="2020-01-01")]}}}}}
    got = readers.company_facts(spark, put(tmp_path / "f.json", json.dumps(body))).collect()
    assert len(got) == 4 and {(r.taxonomy, r.concept, r.unit, r.value, r.accession_number, str(r.period_end)) for r in got} >= {("us-gaap", "Assets", "USD", 5.0, "a", "2020-03-31"), ("us-gaap", "Assets", "CAD", 1.0, "c", "None")}
    assert [str(r.period_start) for r in got if r.taxonomy == "dei"] == ["2020-01-01"]


def test_filing_lists(spark, tmp_path):
    recent = {"accessionNumber": ["a", "b", "c"], "filingDate": ["2020-01-02", "2020-02-02", "2021-01-01"], "reportDate": ["2019-12-31", "", "2020-12-31"], "acceptanceDateTime": ["2020-01-02T21:00:00.000Z", None, "x"], "form": ["8-K", "10-K", "8-K"], "items": ["2.02, 9.01", "", None], "primaryDocument": ["a.htm", "b.htm", "c.htm"]}
    path = put(tmp_path / "s.json", json.dumps({"cik": 7, "filings": {"recent": recent}}))
    got = readers.filing_lists(spark, path, forms=["8-K"], first="2020-01-02", last="2020-12-31").collect()
    assert [(r.accession_number, r["items"], str(r.report_date)) for r in got] == [("a", ["2.02", "9.01"], "2019-12-31")]
    assert {r.accession_number: r["items"] for r in readers.filing_lists(spark, path).collect()}["c"] == []


def test_daily_sources(spark, tmp_path):
    got = readers.daily_csv(spark, put(tmp_path / "p.csv", " Date,Open,HIGH,Low,Close,Volume\n2020-01-02,1,2,0.5,1.5,10\nx,1,1,1,1,1\n2020-01-03,1,1,1,,5\n")).collect()
    assert [(str(r.date), r.close, r.volume) for r in got] == [("2020-01-02", 1.5, 10)]
    with pytest.raises(ValueError):
        readers.daily_csv(spark, put(tmp_path / "h.csv", "<html>\nno prices\n"))
    q = {"open": [1.0, None], "high": [2.0, 2.0], "low": [1.0, 1.0], "close": [1.5, 1.6], "volume": [None, 4]}
    chart = {"chart": {"result": [{"meta": {"symbol": "X"}, "timestamp": [1577982600, 1578069000], "indicators": {"quote": [q]}}]}}
    rows = readers.daily_chart(spark, put(tmp_path / "c.json", json.dumps(chart))).collect()
    assert [(r.symbol, str(r.date), r.close, r.volume) for r in rows] == [("X", "2020-01-02", 1.5, 0)]


def test_documents_and_index_pages(spark, tmp_path):
    put(tmp_path / "a.htm", "<p>x</p>")
    put(tmp_path / "b.txt", "y")
    assert [r.length for r in readers.documents(spark, str(tmp_path)).collect()] == [8]
    page = "<table><tr><th>Seq</th></tr><tr><td>1</td><td>8-K</td><td><a href='/x/a8k.htm'>a8k.htm</a></td><td>8-K</td><td>9</td></tr><tr><td>&nbsp;</td><td>whole</td><td><a href='/x/all.txt'>t</a></td><td></td><td>1</td></tr></table>"
    df = spark.createDataFrame([("p", page), ("q", "<table><tr><td>1</td><td>2</td><td>3</td><td>4</td><td>5</td></tr></table>"), ("r", None)], "k string, page string")
    got = readers.index_pages(df, ["k"], "page").collect()
    assert [(r.seq, r.filename, r.doc_type) for r in got if r.k == "p"] == [(1, "a8k.htm", "8-K"), (None, "all.txt", "")]
    assert {r.k: r.error for r in got if r.error} == {"q": "a document row without a link", "r": "no document rows"}


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    assert sorted(map(tuple, sinks.upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    path = str(tmp_path / "scope")
    sinks.replace_scope(old.withColumn("day", F.lit("x")), path, ["day"])
    sinks.replace_scope(new.withColumn("day", F.lit("y")), path, ["day"])
    sinks.replace_scope(new.where("k = 3").withColumn("day", F.lit("x")), path, ["day"])
    assert sorted((r.day, r.k) for r in spark.read.parquet(path).collect()) == [("x", 3), ("y", 2), ("y", 3)]
    holes = spark.createDataFrame([(1, None), (2, "b")], "k int, v string")
    assert sorted(map(tuple, sinks.completed(holes, spark.createDataFrame([(1, "z")], "k int, v string"), ["k"], ["v"]).collect())) == [(1, "z"), (2, "b")]
    for bad in ([(2, "z")], [(9, "z")]):
        with pytest.raises(ValueError):
            sinks.completed(holes, spark.createDataFrame(bad, "k int, v string"), ["k"], ["v"])
    m = sinks.write_with_manifest(old, str(tmp_path / "out"), {"old": old})
    assert m["rows"] == 2 and sinks.same_as_manifest(spark.read.parquet(str(tmp_path / "out")).repartition(3), m) and not sinks.same_as_manifest(new, m)
    assert sinks.conform(old.select("v", "k"), old.schema).columns == ["k", "v"]
    with pytest.raises(ValueError):
        sinks.conform(old.drop("v"), old.schema)


def test_journal_replay_resume_and_torn_tail(spark, tmp_path):
    put(tmp_path / "j.jsonl", '{"id": 1, "seq": 1, "v": "a", "h": "x"}\n{"id": 1, "seq": 2, "v": "b", "h": "x"}\n{"id": 2, "seq": 3, "v": "c", "h": "x"}\n{"id": 3, "se')
    j = journal.read_journal(spark, str(tmp_path / "j.jsonl"), "id int, seq int, v string, h string")
    assert sorted((r.id, r.v) for r in journal.replay(j, ["id"], ["seq"]).collect()) == [(1, "b"), (2, "c")]
    work = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "id int, h string")
    assert [r.id for r in journal.remaining(work, j, ["id"], "h").collect()] == [3]
    with pytest.raises(ValueError):
        journal.remaining(work.withColumn("h", F.lit("other")), j, ["id"], "h")


def test_stream_resumes_where_it_stopped(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    step = lambda df: df.withColumn("w", F.col("v") * 2)
    spark.createDataFrame([(1, 1), (1, 1), (2, 5)], "id int, v int").write.mode("append").parquet(src)
    journal.process_stream(spark, src, "id int, v int", out, cp, step, ["id"])
    spark.createDataFrame([(3, 7)], "id int, v int").write.mode("append").parquet(src)
    journal.process_stream(spark, src, "id int, v int", out, cp, step, ["id"])
    journal.process_stream(spark, src, "id int, v int", out, cp, step, ["id"])
    got = journal.read_journal(spark, out, "id int, v int, w int, batch int")
    assert sorted((r.id, r.w) for r in got.collect()) == [(1, 2), (2, 10), (3, 14)]


def test_override_files_and_exclusions(spark, tmp_path):
    schema = "cik long, evidence string, first string, last string"
    good = put(tmp_path / "o.csv", "# a comment\ncik,evidence,first,last\n1,seen in the filing,2020-01-01,\n# more\n2,seen in a letter,,2020-06-30\n")
    rows = readers.override_file(spark, good, schema, ["cik"], {"evidence": 8})
    assert rows.count() == 2
    for body in ("1,short,,\n", "1,seen in the filing,,\n1,seen in the filing,,\n", ",seen in the filing,,\n"):
        with pytest.raises(ValueError):
            readers.override_file(spark, put(tmp_path / "bad.csv", "cik,evidence,first,last\n" + body), schema, ["cik"], {"evidence": 8})
    events = spark.createDataFrame([(1, "2019-12-31"), (1, "2020-01-01"), (2, "2020-06-30"), (2, "2020-07-01"), (3, "2020-01-01")], "cik long, day string").withColumn("day", F.col("day").cast("date"))
    left = readers.without_excluded(events, rows, "cik", "day", "first", "last")
    assert sorted((r.cik, str(r.day)) for r in left.collect()) == [(1, "2019-12-31"), (2, "2020-07-01"), (3, "2020-01-01")]


def test_shards_resume_and_merge(spark, tmp_path):
    path = str(tmp_path / "shards")
    part = lambda s: spark.range(s * 10, s * 10 + 5 + s)
    assert sinks.write_shard(part(0), path, 0, "r1") and not sinks.write_shard(part(0), path, 0, "r1")
    with pytest.raises(ValueError, match="not done"):
        sinks.merged_shards(spark, path, 2, "r1")
    assert sinks.write_shard(part(1), path, 1, "r1") and sinks.merged_shards(spark, path, 2, "r1").count() == 11
    assert sinks.write_shard(part(1), path, 1, "r2")
    with pytest.raises(ValueError):
        sinks.merged_shards(spark, path, 2, "r2")
    part(2).write.mode("overwrite").parquet(f"{path}/data/shard=0")
    sinks.write_shard(part(1), path, 1, "r1")
    with pytest.raises(ValueError, match="markers"):
        sinks.merged_shards(spark, path, 2, "r1")
