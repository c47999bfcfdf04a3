"""Small fixtures for operators whose results SQL cannot check, and for edge cases of those it can."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.operators import folds as fo
from meridian.operators import graph, metrics, quality
from meridian.operators import sequence as sq
from meridian.operators import text as tx
from meridian.operators.asof import latest_known, next_after, partner_near

D = date(2020, 1, 1)


def day(n):
    return None if n is None else D + timedelta(n)


def test_latest_known_inclusive_and_strict(spark):
    facts = spark.createDataFrame([("k", day(5), day(1), 1), ("k", day(5), day(2), 2), ("k", day(3), day(9), 3), ("k", None, day(20), 4), (None, day(1), day(1), 5)], "k string, filed date, period date, id int")
    asks = spark.createDataFrame([("k", day(5)), ("k", day(5)), ("k", day(4)), ("k", day(2)), ("z", day(9))], "k string, t date")
    run = lambda inclusive: {(r.k, (r.t - D).days): r.known and r.known.id for r in latest_known(asks, facts, keys=["k"], at="t", available=F.col("filed"), order=[F.col("period"), F.col("id")], inclusive=inclusive).collect()}
    assert run(True) == {("k", 5): 3, ("k", 4): 3, ("k", 2): None, ("z", 9): None}
    assert run(False) == {("k", 5): 3, ("k", 4): 3, ("k", 2): None, ("z", 9): None}
    one = facts.where("id in (1, 2)")
    got = latest_known(asks, one, keys=["k"], at="t", available=F.col("filed"), order=[F.col("period"), F.col("id")], inclusive=False).where("k = 'k'").collect()
    assert all(r.known is None for r in got)


def test_next_after_and_partner(spark):
    e = spark.createDataFrame([("k", day(3)), ("k", day(7)), ("k", None)], "k string, d date")
    q = spark.createDataFrame([("k", day(3)), ("k", day(7)), ("z", day(1))], "k string, t date")
    at = lambda inc: {(r.k, (r.t - D).days): r.next and (r.next - D).days for r in next_after(q, e, keys=["k"], at="t", when="d", inclusive=inc).collect()}
    assert at(False) == {("k", 3): 7, ("k", 7): None, ("z", 1): None} and at(True)[("k", 3)] == 3
    rows = spark.createDataFrame([("k", day(400), "new"), ("k", day(40), "b"), ("k", day(40), "a"), ("k", day(30), "c"), ("k", day(101), "near")], "k string, d date, acc string")
    got = partner_near(rows, keys=["k"], day="d", tie="acc", least=300, most=430, ideal=365).collect()
    assert [(r.acc, r.partner, r.gap) for r in got] == [("new", "a", 360)]


def test_trailing_percentile_against_the_definition(spark):
    rng = random.Random(8)
    rows = [(rng.choice("abcdef"), rng.randint(0, 300), f"{i:04}", None if rng.random() < 0.15 else float(rng.randint(0, 9))) for i in range(250)]
    df = spark.createDataFrame([(e, day(d), t, v) for e, d, t, v in rows], "e string, d date, t string, v double")
    for same in (True, False):
        got = {r.t: r.pct for r in sq.trailing_percentile(df, entity="e", day="d", tie="t", value="v", same_day=same).collect()}
        for e, d, t, v in rows:
            last = {}
            for x in sorted(rows, key=lambda r: (r[1], r[2])):
                if d - 180 <= x[1] and (x[1] <= d if same else x[1] < d):
                    last[x[0]] = x[3]
            if same:
                last[e] = v
            values = [x for x in last.values() if x is not None]
            want = None if v is None or len(values) < 2 else (sum(x < v for x in values) + 0.5 * sum(x == v for x in values)) / len(values)
            assert got[t] == (None if want is None else pytest.approx(want))


def test_neighbour_outliers_repeat_until_stable(spark):
    rows = [(1, day(0), 1e8), (1, day(90), 2e8), (1, day(180), 2e10), (1, day(270), 9e11), (1, day(360), 2.1e8), (2, day(0), 5.0), (2, day(1), -1.0), (3, day(0), 2e13), (3, None, 1e8)]
    df = spark.createDataFrame(rows, "k int, d date, v double")
    got = {(r.k, (r.d - D).days): r.reason for r in sq.neighbour_outliers(df, entity="k", at="d", value="v").collect()}
    assert got == {(1, 270): "jump", (1, 180): "jump", (2, 0): "too_small", (2, 1): "non_positive", (3, 0): "too_large"}


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.lognormal(size=3000), np.repeat(2.0, 500), -5.0, 1e12]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
    p = [0.0, 0.1, 0.5, 0.995, 1.0]
    assert sq.exact_quantiles(df, "v", p) == pytest.approx(np.quantile(x, p).tolist())
    assert sq.exact_quantiles(df.where("v > 1e13 and v < 0"), "v", [0.5]) == [None]


def test_gap_clusters_chain_and_islands(spark):
    df = spark.createDataFrame([("a", day(d)) for d in (1, 5, 9, 15, 15)], "k string, d date")
    got = {(r.d - D).days: r.cluster for r in sq.gap_clusters(df, "k", "d", 5).collect()}
    assert got == {1: 0, 5: 0, 9: 0, 15: 1}
    runs = sq.islands(spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 5)], "k string, p int"), "k", "p").collect()
    assert sorted((r["first"], r["last"], r.n) for r in runs) == [(1, 2, 2), (5, 5, 1)]


def test_rank_correlation_guards(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 9.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0), ("c", None, 1.0)], "g string, x double, y double")
    got = {r.g: r.ic for r in sq.rank_correlation(df, "g", "x", "y").collect()}
    assert got == {"a": pytest.approx(1.0), "b": None}


def test_components_against_union_find(spark):
    rng = random.Random(12)
    pairs = [(f"n{i:03}", None if rng.random() < 0.1 else rng.randint(0, 140)) for i in range(120) for _ in range(2)] + [(f"c{i:03}", i // 2 + 1000 + (i % 2)) for i in range(60)]
    pairs += [(f"c{i:03}", i // 2 + 1000) for i in range(60)]
    parent = {n: n for n, _ in pairs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for n, v in pairs:
        if v is not None:
            a, b = root(n), root(by.setdefault(v, n))
            parent[max(a, b)] = min(a, b)
    got = {r.n: r.component for r in graph.components(spark.createDataFrame(pairs, "n string, v int"), "n", "v").collect()}
    assert got == {n: root(n) for n in parent}


def test_largest_remainder_sums_and_sample_is_stable(spark):
    c = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1)], "k string, n int")
    got = {r.k: r.allocated for r in graph.largest_remainder(c, "k", "n", 10).collect()}
    assert sum(got.values()) == 10 and got == {"a": 4, "b": 3, "c": 2, "d": 1}
    rows = spark.range(100).select((F.col("id") % 3).alias("s"), "id")
    one = sorted(map(tuple, graph.hash_sample(rows, ["s"], "id", 4, "x").collect()))
    assert len(one) == 12 and one == sorted(map(tuple, graph.hash_sample(rows.repartition(7), ["s"], "id", 4, "x").collect()))


def test_text_operators(spark):
    assert tx.plain("<p>One &amp; two</p><script>x()</script><div>three<br>four</div>") == "One & two\nthree\nfour"
    assert tx.plain("a < b") == "a < b" or tx.plain("a &lt; b") == "a < b"
    assert tx.reflow("a b\nc d\ne f g h i\nj", 4) == ["a b c d", "e f g h i"] and tx.reflow("\n \n", 2) == []
    toc = "Item 1. Business\nItem 7. Discussion\n\nItem 1. Business\ntext one\nItem 7. Discussion\ntext two"
    got = [(i, toc[a:b].split("\n")[1]) for i, a, b, _ in tx.sections_by_heading(toc)]
    assert got == [("1", "text one"), ("7", "text two")]
    df = spark.createDataFrame([("a b c d e f",), ("a  b c d E 5 f",), ("a b",), ("",), (None,)], "t string")
    h = [r[0] for r in df.select(tx.shingles(F.col("t"))).collect()]
    assert len(h[0]) == 2 and set(h[0]) == set(h[1]) and h[2] == [] and h[3] == []
    rows = [tuple(r) for r in tx.shingle_rows(df.select(F.lit(1).alias("k"), "t"), ["k"], "t").collect()]
    assert len(rows) == 4 and len(set(rows)) == 2
    n = [r[0] for r in df.select(tx.word_count(F.col("t"))).collect()]
    assert n[:4] == [6, 7, 2, 0]
    g = df.select(tx.letter_share(F.col("t")), tx.control_share(F.lit("a\u0001�"))).collect()
    assert g[0][0] == 1.0 and g[3][0] is None and g[0][1] == pytest.approx(2 / 3)
    r = tx.reflowed(spark.createDataFrame([(1, "a b\nc d"), (2, None)], "k int, t string"), ["k"], "t", 3).collect()
    assert [(x.k, x.position, x.paragraph) for x in r] == [(1, 0, "a b c d")]


PAGE = """<html><body><p><a href="#i1">Item 1. Business</a> <a href="#i7">Item 7. Discussion</a> <a href="#bad">Item 8. Statements</a></p>
<p id="i1"><b>Item 1.</b> Business</p><p>We make valves and pumps for ships.</p><a name="i7"></a><div>Item 7. Discussion</div><p>Sales rose by a tenth this year.</p>
<p id="bad">Signatures follow here on the next page.</p><p>Item 9A. Controls</p><p>Controls were effective at the end of the year.</p></body></html>"""


def test_sections_by_anchor_and_heading(spark):
    assert tx.extract_section(PAGE, "1") == ("Item 1. Business\nWe make valves and pumps for ships.", "anchor", None)
    assert tx.extract_section(PAGE, "7")[0].startswith("Item 7. Discussion\nSales") and tx.extract_section(PAGE, "7")[1:] == ("anchor", None)
    assert tx.extract_section(PAGE, "9A")[1:] == ("heading", None) and "effective" in tx.extract_section(PAGE, "9A")[0]
    assert tx.extract_section(PAGE, "8")[1:] == ("anchor", "foreign_heading") and tx.extract_section(PAGE, "3") == ("", "none", "not_found")
    df = spark.createDataFrame([(1, PAGE), (2, None)], "k int, page string")
    got = {(r.k, r["item"]): (r.method, r.problem) for r in tx.extracted_sections(df, ["k"], "page", ["1", "3"]).collect()}
    assert got == {(1, "1"): ("anchor", None), (1, "3"): ("none", "not_found"), (2, "1"): ("none", "not_found"), (2, "3"): ("none", "not_found")}


def test_word_windows(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a"), (3, None), (4, " ")], "k int, t string")
    got = sorted((r.k, r.window, r.words) for r in tx.word_windows(df, ["k"], "t", 3, 2).collect())
    assert got == [(1, 0, "a b c"), (1, 1, "c d e"), (1, 2, "e f g"), (2, 0, "a")]


def test_packed_windows(spark):
    items = [("s", i, f"p{i}", w) for i, w in enumerate([200, 100, 60, 350, 99, 40])] + [("t", 0, "x", 99), ("u", 0, "y", 100)]
    got = tx.packed_windows(spark.createDataFrame(items, "s string, p int, i string, w int"), ["s"], "p", "i", "w").collect()
    assert sorted((r.s, r.window, r.n_words, tuple(r["items"])) for r in got) == [("s", 0, 360, ("p0", "p1", "p2")), ("s", 1, 350, ("p3",)), ("s", 2, 139, ("p4", "p5")), ("u", 0, 100, ("y",))]


def test_metrics(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("a", None), ("b", None)], "g string, h boolean")
    got = {r.g: (r.n, r.hits, r.rate, r.lower) for r in metrics.rate_by(df, ["g"], F.col("h")).collect()}
    assert got["a"][:3] == (2, 1, 0.5) and got["a"][3] == pytest.approx(0.09453, abs=1e-4) and got["b"] == (0, 0, None, None)
    s = spark.createDataFrame([(0.5, 8, 10), (0.5, 5, 10)], "w double, k int, n int")
    r = metrics.pooled_rate(s, "w", "k", "n").first()
    assert r.rate == pytest.approx(0.65) and 0 < r.lower < 0.65 < r.upper < 1
    assert metrics.pooled_rate(s.unionByName(spark.createDataFrame([(0.1, 0, 0)], "w double, k int, n int")), "w", "k", "n").first().rate is None
    assert metrics.intraclass(spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 5.0), (2, 5.0)], "g int, v double"), "g", "v").first().icc == pytest.approx(1.0)
    auc = metrics.auc_by(spark.createDataFrame([("a", 1, 3.0), ("a", 0, 1.0), ("a", 0, 3.0), ("b", 1, 1.0)], "g string, y int, s double"), "g", "y", "s").collect()
    assert {r.g: r.auc for r in auc} == {"a": 0.75, "b": None}


def test_folds_purge_and_models(spark):
    rows = [(i, day(30 * i), day(30 * i + 63) if i % 5 else None, float(i % 4), "g" if i % 2 else None) for i in range(40)]
    f = fo.walk_forward(spark.createDataFrame(rows, "id int, d date, e date, y double, g string"), "d", closes="e", window=4)
    census = {r.fold: (r.n_train, r.n_test, r.leaks) for r in fo.fold_census(f, "d").collect()}
    assert all(leaks == 0 and train and test for train, test, leaks in census.values())
    late = f.where("role = 'train' and e is not null").select(F.max(F.col("e") >= fo.quarter_start(F.col("fold")))).first()[0]
    assert late is False
    p = fo.group_mean_prediction(f, "g", "y", "id")
    assert p.count() == f.where("role = 'test'").count() and p.where("prediction is null").isEmpty()


def test_ridge_recovers_a_line(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "train" if i < 300 else "test", float(a), float(b), float(3 * a - 2 * b + 1)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame([(1, *r) for r in rows], "fold int, id int, role string, a double, b double, y double")
    got = {r.id: r.prediction for r in fo.ridge_predictions(df, ["a", "b"], "y", "id", l2=1e-6).collect()}
    assert len(got) == 100 and all(abs(got[r[0]] - r[4]) < 1e-3 for r in rows[300:])


def test_principal_axes(spark):
    x = np.random.default_rng(1).normal(size=(200, 4)) * [5, 1, 0.5, 0.1] + 3
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [1.0])], "id int, v array<double>").repartition(5)
    mean, axes = fo.principal_axes(df, "v", 4, 2)
    values, want = np.linalg.eigh(np.cov(x.T, bias=True))
    assert mean == pytest.approx(x.mean(axis=0)) and abs(axes[0] @ want[:, -1]) == pytest.approx(1) and axes[0][np.abs(axes[0]).argmax()] > 0
    got = {r.id: r.pc for r in fo.projected(df, "id", "v", mean, axes).collect()}
    assert got[900] is None and got[901] is None and got[0] == pytest.approx(((x[0] - mean) @ axes.T).tolist())


def test_bootstrap_and_block_length():
    assert fo.block_length([1.0, -1.0] * 10) == 1 and fo.block_length(list(np.cumsum(np.ones(30)))) > 3 and fo.block_length([1.0, 1.0, 1.0]) == 1
    x = np.random.default_rng(2).normal(size=400).tolist()
    assert fo.bootstrap_mean_sd(x, 1, 2000) == pytest.approx(np.std(x, ddof=1) / 20, rel=0.1) and fo.bootstrap_mean_sd([1.0], 1) is None


def test_quality(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, v string")
    r = quality.report([quality.unique_key("key", df, ["k"]), quality.no_rows("nulls", df, F.col("v").isNull(), "WARN")])
    assert {x.check: x.n_bad for x in r.collect()} == {"key": 1, "nulls": 1}
    with pytest.raises(AssertionError, match="key: 1"):
        quality.enforce(r)
    calm = quality.with_exceptions(r, spark.createDataFrame([("key",)], "check string"), ["check"])
    quality.enforce(calm)
    assert {x.check: x.excepted for x in calm.collect()} == {"key": True, "nulls": False}
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert {(x.k, x.change) for x in quality.drift(df.where("v is null or v = 'a'"), new, ["k"], ["v"]).collect()} == {(1, "removed"), (3, "added")}
