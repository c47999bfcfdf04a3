import math
import random
import sqlite3
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridian.functions import scalar as sc
from meridian.operators import folds as fo
from meridian.operators import graph, inference, panel, quality
from meridian.operators import sequence as sq
from meridian.operators import text as tx
from meridian.sources import readers, sinks


def test_assembled(spark):
    base = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "c")], "k long, extra string")
    text = spark.createDataFrame([(1, 5, 2.5), (9, 1, 1.0)], "k long, n long, mean double")
    got = panel.assembled(base, {"text": text}, ["k"], ("n",)).collect()
    assert sorted((r.k or 0, r.n, r.mean, r.has_text) for r in got) == [(0, 0, None, False), (1, 5, 2.5, True), (1, 5, 2.5, True), (2, 0, None, False)]
    with pytest.raises(ValueError):
        panel.assembled(base.withColumnRenamed("extra", "n"), {"text": text}, ["k"])
    whole, counts = panel.complete_rows(base, {"text": text}, ["k"], "mean")
    assert whole.count() == 2 and tuple(counts.first()) == (4, 2, 2)
    assert panel.assembled(base.where("false"), {"text": text}, ["k"]).count() == 0


def test_family_states_and_newer_facts(spark):
    d = date
    facts = spark.createDataFrame(
        [(1, "A", d(2019, 9, 30), d(2019, 11, 1), 1, 5.0), (1, "B", d(2019, 9, 30), d(2019, 11, 2), 2, 6.0), (2, "A", d(2015, 9, 30), d(2015, 11, 1), 3, 7.0), (2, "C", d(2019, 6, 30), d(2019, 8, 1), 4, 8.0),
         (2, "B", d(2019, 6, 30), d(2019, 8, 1), 5, 8.5), (3, "B", d(2019, 6, 30), d(2019, 8, 1), 6, 9.0), (4, "A", d(2019, 9, 30), d(2020, 3, 1), 7, 1.0), (5, None, None, None, 8, None)],
        "e long, c string, end date, filed date, id long, v double")
    fam = spark.createDataFrame([("f", "A", 1), ("f", "B", 2), ("f", "C", 3)], "family string, c string, preference int")
    out = panel.family_facts(facts, fam, F.lit("2020-01-01").cast("date"), entity="e", concept="c", end="end", filed="filed", tie="id", value="v", fresh_days=400)
    assert {r.e: (r.state, r.value, r.newer_concept, r.newer_value) for r in out.collect()} == {1: ("resolved", 5.0, None, None), 2: ("stale", 7.0, "B", 8.5), 3: ("partial", None, "B", 9.0)}


def test_calls_and_chance(spark):
    calls = spark.createDataFrame([(1, 2, True), (1, 2, False), (1, 1, False), (2, 1, True)], "e int, o int, hit boolean")
    got = {r.e: (r.n_calls, r.n_hits, r.hit_rate, r.calls) for r in panel.entity_table(calls, "e", "o", F.col("hit"), 2).collect()}
    assert got == {1: (3, 1, round(1 / 3, 6), "1:0/1 2:1/2"), 2: (1, 1, None, "1:1/1")}
    assert panel.entity_table(calls.where("false"), "e", "o", F.col("hit"), 2).count() == 0
    assert spark.range(1).select(panel.chance_hits(F.lit(3), F.lit(1), F.lit(0.6))).first()[0] == pytest.approx(3 * 0.6 + 0.4)
    r = calls.where("false").agg(*panel.precision_recall(F.col("hit"), F.col("hit"))).first()
    assert (r.n_true, r.precision, r.recall, r.f1) == (0, None, None, None)


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    day = lambda s: F.lit(s).cast("date")
    assert one(sc.quarter_ends(day("2019-12-31"), day("2020-06-29"))) == [date(2019, 12, 31), date(2020, 3, 31)]
    assert one(sc.yearly_dates(2019, 2020, 6, 30)) == [date(2019, 6, 30), date(2020, 6, 30)]
    assert [one(sc.amount_text(F.lit(v), F.lit(u))) for v, u in ((1.5e9, "USD"), (-2.5e6, "USD"), (12.0, "shares"), (1.234, "USD/shares"), (None, "USD"))] == ["1.5bn USD", "-2.5m USD", "12 shares", "1.23 USD/shares", None]
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert [one(sc.common_ticker(t, v)) for t, v in ((arr("AB-WS", "AB", "CD"), arr()), (arr("AB.U"), arr()), (arr("AB"), arr("AB")), (arr(), arr()))] == ["AB", None, None, None]
    kind = lambda f, i: one(sc.event_kind(F.lit(f), F.lit(i), {"25": "out"}, {"1.03": "broke", "5.02": "left"}))
    assert [kind("25/A", "1.03"), kind("8-K", "5.02, 1.03"), kind("8-K", None), kind(None, "5.02")] == ["out", "broke", None, "left"]


def test_texts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(tx.exhibit_number(F.lit(t))) for t in ("Exhibit 99.1 release", "EX-10", "text", None)] == ["99.1", "10", "", None]
    assert [one(tx.stub_kind(F.lit(t))) for t in ("Item 6. [Reserved]", "Not applicable.", "Incorporated by reference to the proxy", "A long tale", None)] == ["reserved", "not_applicable", "by_reference", None, None]
    assert one(tx.stub_kind(F.lit("reserved " + "word " * 2000))) is None
    assert [one(tx.foreign_item(F.lit(t), "7")) for t in ("Item 7. MD&A", "ITEM 7A. Risk", "text", None)] == [None, "7A", None, None]
    assert [one(tx.names_results(F.lit(t))) for t in ("third quarter 2020 results", "loss per share", "the weather", None)] == [True, True, False, None]
    r = spark.createDataFrame([("one two three four five six seven eight nine ten\n\nshort line",), (None,), ("",)], "t string").select(*tx.prose_measures(F.col("t"))).collect()
    assert tuple(r[0]) == (2, 1, 10, round(10 / 12, 6)) and r[1].prose_share is None and r[2].n_prose_lines == 0


def test_reflow_examples():
    assert tx.reflow("a b c\nd\ne f g h i j\nk\nl m\nn o p q r s\nt", 4) == ["a b c d", "e f g h i j", "k l m", "n o p q r s"]
    assert tx.reflow("a b c d\ne\n\n f g h \ni", 4) == ["a b c d", "e f g h"]
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.randint(0, 6) for _ in range(rng.randint(0, 12))]
        out = tx.reflow("\n".join("w " * n for n in sizes), 4)
        whole = sum(sizes)
        kept = sum(len(p.split()) for p in out)
        assert whole - 4 < kept <= whole or not out  # what is left out at the end is shorter than a paragraph
        long = [n for n in sizes if n >= 4]
        assert [len(p.split()) for p in out if len(p.split()) in long].__len__() >= len(long)


def test_bootstrap_of_blocks():
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    assert fo.bootstrap_mean_sd(list(x), 200) == pytest.approx(0, abs=1e-12) and fo.bootstrap_mean_sd([3.0] * 9, 4) == pytest.approx(0, abs=1e-12)
    y = np.repeat(rng.normal(size=40), 5)
    assert fo.bootstrap_mean_sd(list(y), 5, 4000) > 1.5 * fo.bootstrap_mean_sd(list(y), 1, 4000)


@pytest.mark.parametrize("same_day", [True, False])
def test_percentiles_do_not_depend_on_the_ranges(spark, same_day):
    rng = random.Random(4)
    rows = [(rng.randint(1, 25), date.fromordinal(737000 + rng.randint(0, 400)), f"t{i}", rng.choice([None, float("nan"), 1.0, 1.0, 2.0, rng.gauss(0, 3)])) for i in range(300)]
    df = spark.createDataFrame(rows, "e long, d date, t string, v double")
    a, b = ({(r.e, r.d, r.t): r.pct for r in sq.trailing_percentile(df, entity="e", day="d", tie="t", value="v", same_day=same_day, range_rows=n).collect()} for n in (10**9, 20))
    assert a == pytest.approx(b) and len(a) == 300

    def brute(e, d, t, v):
        if v is None or v != v:
            return None
        last = {}
        for q in rows:
            if (q[1] <= d if same_day else q[1] < d) and (d - q[1]).days <= 180 and (q[0] not in last or (q[1], q[2]) > last[q[0]][:2]):
                last[q[0]] = (q[1], q[2], q[3])
        if same_day:
            last[e] = (d, t, v)
        values = [x for *_, x in last.values() if x is not None and x == x]
        return (sum(x < v for x in values) + 0.5 * sum(x == v for x in values)) / len(values) if len(values) >= 2 else None

    want = {(str(e), d, t): brute(e, d, t, v) for e, d, t, v in rows}
    assert a == pytest.approx(want)


def test_rank_correlation_of_many_equal_pairs(spark):
    rows = spark.range(0, 200_000).selectExpr("1 as g", "cast(id % 2 as double) as x", "cast(id % 2 as double) as y").unionByName(spark.createDataFrame([(1, 5.0, -1.0), (2, 1.0, 1.0)], "g int, x double, y double"))
    got = {r.g: (r.n, r.ic) for r in sq.rank_correlation(rows, "g", "x", "y").collect()}
    assert got[1][0] == 200_001 and 0.99 < got[1][1] < 1 and got[2] == (1, None)


def test_quantiles_in_one_pass(spark):
    rng = random.Random(8)
    values = [rng.choice([0.0, 1.0, rng.gauss(0, 1e6), float("nan")]) for _ in range(2000)] + [None]
    got = sq.exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", [0, 0.1, 0.5, 0.999, 1])
    assert got == pytest.approx(np.quantile([v for v in values if v is not None and v == v], [0, 0.1, 0.5, 0.999, 1]).tolist())


def test_components_of_a_giant_and_a_chain(spark):
    rows = [(i, 0) for i in range(400)] + [(1000 + i, 10 + i) for i in range(60)] + [(1001 + i, 10 + i) for i in range(60)] + [(5000, None), (None, 3)]
    got = {r.n: r.component for r in graph.components(spark.createDataFrame(rows, "n long, v long"), "n", "v").collect()}
    assert {got[i] for i in range(400)} == {0} and {got[1000 + i] for i in range(61)} == {1000} and got[5000] == 5000 and len(got) == 462


def test_stratified_components(spark):
    rng = random.Random(3)
    rows = [(f"g{i}", 0, "common") for i in range(500)]  # a component with more than a third of all nodes
    for c in range(1, 300):
        rows += [(f"n{c}-{k}", c, rng.choice(["common", "common", "common", "rare", None])) for k in range(rng.randint(1, 4))]
    df = spark.createDataFrame(rows + rows[:50], "n string, c long, l string")
    split = {r.c: r.split for r in graph.stratified_components(df, "n", "c", "l").collect()}
    assert len(split) == 300 and split[0] == "train"
    total = len({r[0] for r in rows})
    in_eval = {r[0] for r in rows if split[r[1]] == "eval"}
    assert 0 < len(in_eval) <= 1.5 * 0.15 * total
    rare = [r for r in rows if r[2] == "rare"]
    got = sum(split[r[1]] == "eval" for r in rare)
    assert 0.15 * len(rare) <= got <= 0.35 * len(rare)
    assert split == {r.c: r.split for r in graph.stratified_components(df.repartition(7), "n", "c", "l").collect()}
    few = spark.createDataFrame([(f"x{i}", i, "l") for i in range(20)], "n string, c long, l string")
    assert {r.split for r in graph.stratified_components(few, "n", "c", "l").collect()} == {"train"}  # too few to give any away
    assert graph.stratified_components(few.where("false"), "n", "c", "l").count() == 0


def test_intervals_and_effects():
    assert inference.chi_square_quantile(0.95, 1) == pytest.approx(3.841459, rel=1e-6) and inference.chi_square_quantile(0.5, 10) == pytest.approx(9.341818, rel=1e-6)
    lo, hi = inference.deviation_interval(2.0, 11)
    assert (lo, hi) == pytest.approx((2 * math.sqrt(10 / 20.48318), 2 * math.sqrt(10 / 3.246973)), rel=1e-5) and inference.deviation_interval(1.0, 1) is None
    assert inference.smallest_effect(1.0, 100) == pytest.approx(0.28016, rel=1e-4) and inference.smallest_effect(1.0, 100, rho=0.5) > 1.7 * inference.smallest_effect(1.0, 100)
    assert inference.smallest_effect(1.0, 100, tests=5) > inference.smallest_effect(1.0, 100) and inference.smallest_effect(1.0, 0) is None


def test_guards(spark):
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    quality.assert_digests({"t": t}, {"t": sinks.digest(t)})
    with pytest.raises(AssertionError):
        quality.assert_digests({"t": t.withColumn("v", F.lit("b"))}, {"t": sinks.digest(t)})
    with pytest.raises(AssertionError):
        quality.assert_digests({}, {"t": sinks.digest(t)})
    assert quality.validated({"n": 3}, {"n": int}, {"n": lambda x: x > 0}) == {"n": 3}
    for bad in ({}, {"n": "3"}, {"n": True}, {"n": 0}, {"n": 3, "m": 1}):
        with pytest.raises(ValueError):
            quality.validated(bad, {"n": int}, {"n": lambda x: x > 0})
    quality.assert_one_variant(t, {"v": "a"})
    with pytest.raises(AssertionError):
        quality.assert_one_variant(t.unionByName(spark.createDataFrame([(2, None)], t.schema)), {"v": "a"})


def test_csv_sqlite_and_frames(spark, tmp_path):
    (tmp_path / "u.csv").write_text("cik,tags,day\n1,A| B||C,2020-01-02\n2,,\n")
    rows = readers.csv_table(spark, str(tmp_path / "u.csv"), "cik long, tags string, day date", {"tags": "|"}).collect()
    assert [(r.cik, r.tags, r.day) for r in rows] == [(1, ["A", "B", "C"], date(2020, 1, 2)), (2, [], None)]
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as con:
        con.execute('create table "spells" (cik integer, member_to text, w real)')
        con.executemany("insert into spells values (?, ?, ?)", [(i, None if i % 3 else "2020-02-0%d" % (i % 9 + 1), i / 2) for i in range(1000)] + [(5000, "no day", None)])
        con.execute("create table empty (a integer)")
        con.execute("delete from spells where cik between 100 and 150")
    schema = T.StructType([T.StructField("cik", T.LongType()), T.StructField("member_to", T.DateType()), T.StructField("w", T.DoubleType())])
    got = readers.sqlite_table(spark, path, "spells", schema, rows_per_task=90).collect()
    assert len(got) == 950 and {r.cik: r.w for r in got}[999] == 499.5 and {r.cik: r.member_to for r in got}[5000] is None and {r.cik: r.member_to for r in got}[0] == date(2020, 2, 1)
    assert readers.sqlite_table(spark, path, "spells", schema, where="cik < 10").count() == 10
    assert readers.sqlite_table(spark, path, "empty", T.StructType([T.StructField("a", T.LongType())])).count() == 0
    (tmp_path / "q.json").write_text('{"taxonomy": "t", "tag": "Assets", "ccp": "CY2020Q1I", "uom": "USD", "data": [{"accn": "a", "cik": 7, "entityName": "x", "end": "2020-03-31", "val": 5}]}')
    (r,) = readers.frames(spark, str(tmp_path / "q.json")).collect()
    assert (r.concept, r.frame, r.cik, r.end, r.value) == ("Assets", "CY2020Q1I", 7, date(2020, 3, 31), 5.0)


def test_first_source(spark):
    full = spark.createDataFrame([(1,)], "k int")

    def broken():
        raise OSError("down")

    assert [tuple(r) for r in readers.first_source([("a", broken), ("b", lambda: full.where("false")), ("c", lambda: full)]).collect()] == [(1, "c")]
    with pytest.raises(ValueError, match="a: OSError; b: no rows"):
        readers.first_source([("a", broken), ("b", lambda: full.where("false"))])


def test_vectors_reports_and_caches(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "k int, v array<double>")
    sinks.write_vectors(v, str(tmp_path / "v"), "v", 2)
    back = spark.read.parquet(str(tmp_path / "v"))
    assert back.schema["v"].dataType == T.ArrayType(T.FloatType()) and back.count() == 2
    with pytest.raises(ValueError):
        sinks.write_vectors(v, str(tmp_path / "w"), "v", 3)
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "k int, s string").repartition(2)
    sinks.write_report(rows, str(tmp_path / "r"), ["k"])
    (part,) = (tmp_path / "r").glob("*.csv")
    assert part.read_text() == "k,s\n1,a\n2,b\n"
    sinks.write_report(rows, str(tmp_path / "j"), ["k"], "json")
    assert len(list((tmp_path / "j").glob("*.json"))) == 1
    built = []

    def build():
        built.append(1)
        return rows

    path = str(tmp_path / "cache")
    for version, source, times in (("1", v, 1), ("1", v, 1), ("2", v, 2), ("2", v.where("k = 1"), 3), ("2", v.where("k = 1"), 3)):
        assert sinks.cached_table(spark, path, version, {"v": source}, build).count() == 2 and len(built) == times


def test_difference_of_correlations(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(size=300)
    rows = [(i, float(y[i] + 0.3 * e), float(n), float(y[i])) for i, (e, n) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows + [(None, 1.0, 1.0, 1.0), (999, None, 1.0, 1.0)], "i long, a double, b double, y double")
    got = inference.correlation_difference(df, "i", "a", "b", "y", draws=300)
    a, b, t = np.array(rows)[:, 1:].T
    assert got["n"] == 300 and got["difference"] == pytest.approx(np.corrcoef(a, t)[0, 1] - np.corrcoef(b, t)[0, 1])
    again = inference.correlation_difference(df.repartition(5), "i", "a", "b", "y", draws=300)
    assert again["sd"] == pytest.approx(got["sd"]) and 0.03 < got["sd"] < 0.09
    assert inference.correlation_difference(df.withColumn("a", F.lit(1.0)), "i", "a", "b", "y", draws=5)["difference"] is None
    assert inference.correlation_difference(df.where("false"), "i", "a", "b", "y", draws=5) == {"difference": None, "sd": None, "n": 0}


def test_axes_of_each_fold_know_its_training_rows_alone(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(60, 4)) * [5, 2, 1, 0.1]
    rows = [(1, "train", i, v[i].tolist()) for i in range(40)] + [(1, "test", i, v[i].tolist()) for i in range(40, 60)] + [(2, "train", i, v[i].tolist()) for i in range(20)]
    rows += [(2, "test", 50, v[50].tolist()), (2, "test", 51, None), (2, "test", 52, [1.0]), (2, "train", 53, [1.0]), (3, "test", 1, v[1].tolist())]
    got = {(r.fold, r.i): r.pc for r in fo.fold_axes(spark.createDataFrame(rows, "fold int, role string, i long, v array<double>"), "i", "v", 4, 2).collect()}
    assert got[2, 51] is None and got[2, 52] is None and (3, 1) not in got
    for fold, n in ((1, 40), (2, 20)):
        m = v[:n].mean(axis=0)
        _, _, axes = np.linalg.svd(v[:n] - m)
        want = np.abs((v[50] - m) @ axes[:2].T)
        assert np.abs(got[fold, 50]) == pytest.approx(want)
    no_vectors = spark.createDataFrame([(1, "train", 1, None), (1, "test", 2, [1.0])], "fold int, role string, i long, v array<double>").repartition(3)
    assert fo.fold_axes(no_vectors, "i", "v", 4, 2).count() == 0
    mean, axes = fo.principal_axes(spark.createDataFrame([(x.tolist(),) for x in v], "v array<double>"), "v", 4, 2)
    assert mean == pytest.approx(v.mean(axis=0)) and np.abs(axes) == pytest.approx(np.abs(np.linalg.svd(v - v.mean(axis=0))[2][:2]))


def test_ladders_paths_and_counts(spark):
    rows = spark.createDataFrame([("a", 3, "y"), ("a", 2, "y"), ("a", 1, "z"), ("b", 5, "x"), ("b", 6, "x"), ("c", 9, "z"), ("c", 9, "z"), (None, 1, "x")], "k string, i int, s string")
    got = {r.k: (r.i, r.confidence) for r in panel.first_by_rules(rows, "k", [(F.col("s") == "x", "high"), (F.col("s") == "y", "low")], "i").collect()}
    assert got == {"a": (2, "low"), "b": (5, "high"), "c": (None, None), None: (1, "high")}
    assert sorted((r.k, r.i) for r in panel.first_of_path(rows, "k", [F.col("i")]).collect()) == [("a", 1), ("b", 5), ("c", 9)]
    assert quality.assert_count("rows", rows, 8) is rows
    with pytest.raises(AssertionError):
        quality.assert_count("rows", rows, 7)


def test_slices_and_recovered_sections(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(tx.sliced_from(F.lit(t), "(?i)results for")) for t in ("Intro. Results for the year are up", "none", None)] == ["Results for the year are up", None, None]
    page = "<p>see Item 7 below</p><p>text and then Item 7. our discussion of liquidity and results runs on Item 8. statements</p>"
    assert tx.recovered_section(page, "7", ["liquidity"]) == ("Item 7. our discussion of liquidity and results runs on", "recovered")
    assert [tx.recovered_section(page, i, k)[1] for i, k in (("7", ["inventory"]), ("8", []), ("9", []))] == ["keyword_missing", "short", "not_named"]
    assert tx.recovered_section("<p>Item 7. Discussion</p><p>we talk of many things here</p>", "7", ["x"])[1] == "found"


def test_imputed_segments_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("UP", True), (None, True), (None, False), ("UP", None)], "v string, a boolean").select(sc.imputed(F.col("v"), F.col("a"), "NONE").alias("s")).collect()
    assert [tuple(r.s) for r in rows] == [("UP", False), ("NONE", True), (None, False), (None, False)]
    c = spark.createDataFrame([(i, s) for i, s in enumerate([5, 5, None, 50, 5, 5, -1])], "c long, s long")
    got = {r.c: r.segment for r in graph.segment_plan(c, "c", "s", 4).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 3, 5: 3, 6: 3} and graph.segment_plan(c.where("false"), "c", "s", 4).count() == 0
    t = spark.createDataFrame([(2, "b|c"), (1, None)], "k int, s string")
    sinks.write_markdown(t, str(tmp_path / "m"), ["k"], "Title")
    (part,) = (tmp_path / "m").glob("*.txt")
    assert part.read_text() == "# Title\n\n| k | s |\n| - | - |\n| 1 |  |\n| 2 | b\\|c |\n"
    with pytest.raises(ValueError):
        sinks.write_markdown(t, str(tmp_path / "m"), ["k"], "Title", most=1)
    assert sinks.ordered_json([("a", 1), ("c", 2)], ["a", "b", "c"]) == '{"a": 1, "c": 2}'
    for bad in ([("c", 1), ("a", 2)], [("a", 1), ("a", 1)], [("x", 1)]):
        with pytest.raises(ValueError):
            sinks.ordered_json(bad, ["a", "b", "c"])
    many = spark.range(50).withColumnRenamed("id", "k")
    assert sinks.write_shards(many, str(tmp_path / "sh"), "k", 3, "r1").count() == 50 == sinks.write_shards(many.where("false"), str(tmp_path / "sh"), "k", 3, "r1").count()
