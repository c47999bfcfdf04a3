import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.functions import scalar as sc
from meridian.operators import inference, order, sessions
from meridian.operators.families import classify
from meridian.session import estimated_bytes, shuffle_partitions

D = date(2024, 1, 1)


def day(n):
    return D + timedelta(n)


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(sc.safe_ratio(lit(1.0), lit(1e-7))) is None and one(sc.safe_ratio(lit(float("nan")), lit(2.0))) is None and one(sc.safe_ratio(lit(1), lit(4))) == 0.25
    assert one(sc.signed_growth(lit(-1.0), lit(-2.0))) == 0.5 and one(sc.log_level(lit(-1.0))) is None
    assert one(sc.same_unit_ratio(lit(1.0), lit(2.0), lit("USD"), lit("CAD"))) is None and one(sc.same_unit_ratio(lit(1.0), lit(2.0), lit("USD"), lit(""))) == 0.5
    assert one(sc.quarter_label(lit("2024-05-01").cast("date"))) == "2024Q2" and one(sc.quarters_before(lit("2024-05-01").cast("date"), 2)) == [2024 * 4 - 1 + 0 + 0, 2024 * 4][-2:]
    assert one(sc.unit_currency(lit("USD/shares"))) == "USD" and one(sc.unit_currency(lit("shares"))) == ""
    assert one(sc.base_form(lit(" 10-k/a "))) == "10-K" and one(sc.padded_id(lit(77))) == "0000000077"
    assert one(sc.archive_path(lit(7), lit("0001-20-3"), lit("x.htm"))) == "archive/7/0001203/x.htm"
    assert one(sc.exhibit_type(lit("ex-99.01"))) == "EX-99.1" and one(sc.exhibit_type(lit("EX-10"))) == "EX-10"
    assert one(sc.split_ratio(lit("3:2"))) == 1.5 and one(sc.split_ratio(lit("0:2"))) is None and one(sc.split_ratio(lit("x"))) is None
    assert one(sc.has_item(lit("1.01, 2.02"), "2.02")) is True and one(sc.has_item(lit("12.02"), "2.02")) is False and one(sc.has_item(lit(None).cast("string"), "2.02")) is False


def test_news_day_and_sessions(spark):
    rows = [
        ("before", day(1), datetime(2024, 1, 2, 20, 59)), ("after", day(1), datetime(2024, 1, 2, 21, 0)), ("summer", date(2024, 7, 2), datetime(2024, 7, 2, 20, 0)),
        ("unknown", day(1), None), ("friday", day(4), datetime(2024, 1, 5, 22, 0)), ("next_day", day(1), datetime(2024, 1, 4, 3, 0)), ("end", date(2024, 12, 31), datetime(2024, 12, 31, 22, 0)),
    ]
    e = spark.createDataFrame(rows, "id string, filed date, accepted timestamp_ntz")
    news, late = sessions.news_day(F.col("filed"), F.col("accepted"))
    cal = spark.createDataFrame([(day(i),) for i in range(366) if day(i).weekday() < 5], "s date")
    got = {r.id: (r.day, r.late, r.news_session) for r in sessions.news_sessions(e.withColumn("day", news).withColumn("late", late), cal, day="day", late="late", session="s").collect()}
    assert got["before"] == (day(1), False, day(1)) and got["after"] == (day(1), True, day(2)) and got["summer"][1] is True
    assert got["unknown"] == (None, False, None) and got["friday"] == (day(4), True, day(7)) and got["next_day"] == (day(2), True, day(3)) and got["end"][2] is None


def test_row_index_is_the_total_order(spark):
    rng = random.Random(3)
    values = [(rng.randint(0, 50), i) for i in range(2000)]
    df = spark.createDataFrame(values, "a int, b int").repartition(9)
    got = [(r.a, r.b) for r in order.row_index(df, [F.col("a"), F.col("b")]).orderBy("index").collect()]
    assert got == sorted(values)
    assert order.row_index(df.where("false"), [F.col("a")]).count() == 0


def test_positions_and_ranks_within_groups(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(9)]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(6)
    got = {r.i: (r.position, r.group_size) for r in order.position_in_group(df, ["g"], [F.col("v"), F.col("i")]).collect()}
    for g in ("a", "b", None):
        mine = sorted((-1 if v is None else v, i) for h, v, i in rows if h == g)
        assert [got[i] for _, i in mine] == [(k, len(mine)) for k in range(len(mine))]
    for r in order.value_ranks(df, ["g"], "v").collect():
        values = [v for h, v, _ in rows if h == r.g and v is not None]
        assert (r.lowest, r.ties, r.group_size) == (1 + sum(v < r.v for v in values), values.count(r.v), len(values))


def test_forward_change(spark):
    p = spark.createDataFrame([("u", 0, 2.0), ("u", 2, 3.0), ("u", 4, 0.0)], "u string, p int, v double")
    assert {r.p: r.change for r in sessions.forward_change(p, "u", "p", "v", 2).collect()} == {0: 0.5, 2: None, 4: None}


def quarters(*spans):
    return [q for a, b in spans for q in range(a, b)]


def test_family_states(spark):
    fam = spark.createDataFrame([("rev", "A", 1), ("rev", "B", 2), ("rev", "C", 3), ("cash", "K", 1)], "family string, concept string, preference int")
    cover = {
        "single": {"A": quarters((0, 20))}, "dominant": {"B": quarters((0, 20)), "A": quarters((2, 20))}, "moved": {"A": quarters((0, 10)), "B": quarters((10, 20))},
        "overlap": {"A": quarters((0, 13)), "B": quarters((7, 20)), "C": quarters((18, 20))}, "dead": {"A": quarters((0, 16)), "K": quarters((19, 20))}, "thin": {"A": [0, 3], "K": quarters((0, 20))}, "only_k": {"K": [5]},
    }
    rows = [(e, c, q) for e, cs in cover.items() for c, qs in cs.items() for q in qs]
    got = {(r.e, r.family): r for r in classify(spark.createDataFrame(rows + rows[:9], "e string, concept string, q int"), fam, entity="e", concept="concept", quarter="q").collect()}
    state = {e: got[e, "rev"].state for e in cover}
    assert state == {"single": "SINGLE", "dominant": "DOMINANT", "moved": "MIGRATION", "overlap": "OVERLAP", "dead": "PARTIAL", "thin": "PARTIAL", "only_k": "ABSENT"}
    assert got["dominant", "rev"].winner == "A" and got["moved", "rev"].switch_quarters == [10] and got["moved", "rev"].winner is None
    assert got["single", "cash"].state == "ABSENT" and got["thin", "rev"].coverage == 0.1 and got["only_k", "cash"].state == "SINGLE"


def test_wild_cluster_bootstrap(spark):
    rng = np.random.default_rng(5)
    n = 600
    x, c = rng.normal(size=n), np.arange(n) % 30
    strong = spark.createDataFrame([(float(a), float(2 * a + e), int(k)) for a, e, k in zip(x, rng.normal(size=n), c)], "x double, y double, c int")
    none = spark.createDataFrame([(float(a), float(e), int(k)) for a, e, k in zip(x, rng.normal(size=n), c)], "x double, y double, c int")
    r = inference.wild_cluster_p(strong.repartition(5), "x", "y", "c", draws=199)
    assert r["slope"] == pytest.approx(2, abs=0.2) and r["p"] == pytest.approx(1 / 200) and r["n_clusters"] == 30
    assert r == inference.wild_cluster_p(strong.coalesce(1), "x", "y", "c", draws=199) or abs(r["slope"] - inference.wild_cluster_p(strong.coalesce(1), "x", "y", "c", draws=199)["slope"]) < 1e-9
    assert inference.wild_cluster_p(none, "x", "y", "c", draws=199)["p"] > 0.02
    assert inference.wild_cluster_p(none.where("false"), "x", "y", "c")["p"] is None and inference.wild_cluster_p(none.where("c = 1"), "x", "y", "c")["p"] is None


def test_cluster_bootstrap(spark):
    df = spark.createDataFrame([(i % 40, (i * 7) % 3 == 0, 1) for i in range(2000)], "c int, hit boolean, one int").withColumn("hit", F.col("hit").cast("int"))
    r = inference.cluster_bootstrap(df, "c", "hit", "one", draws=400)
    assert r["lower"] <= r["rate"] <= r["upper"] and r["rate"] == pytest.approx(1 / 3, abs=0.01) and r["upper"] - r["lower"] < 0.1
    assert inference.cluster_bootstrap(df.where("false"), "c", "hit", "one")["rate"] is None


def test_logistic(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4000, 2))
    y = rng.random(4000) < 1 / (1 + np.exp(-(0.5 + 1.5 * x[:, 0] - x[:, 1])))
    df = spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, y)] + [(None, 1.0, 1)], "a double, b double, y int")
    beta = inference.logistic_l2(df, ["a", "b"], "y", l2=1e-3)
    assert beta == pytest.approx([0.5, 1.5, -1.0], abs=0.15)
    m = np.c_[np.ones(4000), x]
    assert np.abs(m.T @ (y - 1 / (1 + np.exp(-m @ beta)))).max() < 0.01  # the score is zero there


def test_closed_forms():
    e = inference.equivalence(0.0, 1.0, 2.0)
    assert e["p"] == pytest.approx(0.02275, abs=1e-4) and e["upper"] == pytest.approx(1.645, abs=1e-3)
    assert inference.smallest_margin(0.01, [0.1, 0.02, 0.05]) == 0.05 and inference.smallest_margin(1.0, [0.1]) is None
    assert inference.binomial_tail(3, 0.5, 2) == pytest.approx(0.5) and inference.binomial_tail(3, 0.5, 0) == pytest.approx(1)


def test_session_helpers(spark):
    assert shuffle_partitions(spark) == 4 and estimated_bytes(spark.range(10)) > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    names = e.queries()
    assert set(e.oracle_sql()) <= set(names) and {"p3_found", "p4_found", "p7_found"} <= set(names)
    assert e.entry(spark).columns == ["accession_number", "cik", "filing_date", "public_float", "float_filed"]


def test_masks_ranges_and_wrappers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    n, lit = F.lit(None).cast("boolean"), F.lit
    assert one(sc.masked(lit(1), lit(False), n)) == 1 and one(sc.masked(lit(1), n, lit(True))) is None
    code = lambda k: one(sc.in_ranges(lit(k), {6798: "trust"}, [(6000, 6799, "finance"), (1, 999, "farm")], "none"))
    assert [code(6798), code(6000), code(999), code(5000), code(0)] == ["trust", "finance", "farm", "none", "none"] and one(sc.in_ranges(lit(None).cast("int"), {}, [(1, 2, "a")], "none")) == "none"
    assert one(sc.unwrapped_document(lit("<DOC>\n<TEXT>\nbody <b>x</b>\n</TEXT></DOC>"))) == "body <b>x</b>" and one(sc.unwrapped_document(lit("plain"))) == "plain"


def test_owners(spark):
    from meridian.operators import quality

    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "acc string, cik int")
    owners = quality.one_owner(rows, "acc", "cik")
    assert quality.attached(rows.select("acc"), owners, "acc").count() == 3
    with pytest.raises(AssertionError, match="a"):
        quality.one_owner(rows.unionByName(spark.createDataFrame([("a", 9)], "acc string, cik int")), "acc", "cik")
    with pytest.raises(AssertionError, match="z"):
        quality.attached(spark.createDataFrame([("z",)], "acc string"), owners, "acc")


def test_paired_measures_and_fold_deltas(spark):
    from meridian.operators import metrics

    df = spark.createDataFrame([("g", 1.0, 2.0), ("g", 2.0, 3.0), ("g", 4.0, 5.0), ("h", 1.0, 1.0), ("h", None, 1.0)], "g string, a double, b double")
    got = {r.g: (r.n, r.mean_difference, r.correlation) for r in metrics.paired_measures(df, ["g"], "a", "b").collect()}
    assert got == {"g": (3, -1.0, pytest.approx(1.0)), "h": (1, 0.0, None)}
    s = spark.createDataFrame([(1, "base", 0.1), (1, "x", 0.3), (2, "x", 0.9), (3, "base", 0.2), (3, "x", 0.1)], "fold int, block string, ic double")
    assert {(r.fold, round(r.delta, 6)) for r in metrics.fold_deltas(s, "fold", "block", "ic", "base").collect()} == {(1, 0.2), (3, -0.1)}
