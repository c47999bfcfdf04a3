import random

import pytest

from meridian.llm.mix import _uniform, mix_sources, mixture_report, pivot, share_plan


def planned(spark, sizes, targets, total=None):
    n = spark.createDataFrame(list(sizes.items()), "source string, n_tokens long")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return {r.source: r for r in share_plan(n, t, total).collect()}


def test_plan_is_as_large_as_the_scarcest_source_allows(spark):
    plan = planned(spark, {"a": 1000, "b": 10, "c": 5, "z": 0}, [("a", 0.5, 2), ("b", 0.25, 4), ("x", 0.25, 9), ("z", 0.1, 3), ("c", 0.0, 3), ("n", None, None)])
    assert set(plan) == {"a", "b"} and plan["b"].expected_copies == 4 and plan["a"].normalised_share == pytest.approx(2 / 3) and plan["a"].expected_copies == pytest.approx(0.08)
    assert planned(spark, {}, [("a", 1.0, 1)]) == {} and planned(spark, {"a": 1}, []) == {}
    big = {s: r.expected_copies for s, r in planned(spark, {"a": 100, "b": 10}, [("a", 0.5, 2), ("b", 0.5, 3)], total=150).items()}
    assert big == {"a": 0.75, "b": 3.0}


def test_pivot_keeps_the_mass_and_decides_all_but_one():
    rng = random.Random(7)
    for trial in range(200):
        units = [(i, float(rng.randint(1, 500)), rng.choice([0.3, 0.5, 0.999, 1.0, 0.0, 1e-9])) for i in range(rng.randint(0, 30))]
        decided, left = pivot(iter(units), trial)
        mass = {i: m for i, m, _ in units}
        assert sorted([i for i, _ in decided] + ([left[0]] if left else [])) == [i for i, *_ in units]
        reached = sum(mass[i] * x for i, x in decided) + (left[1] * left[2] if left else 0)
        assert reached == pytest.approx(sum(m * p for _, m, p in units), abs=1e-6)


def test_pivot_is_unbiased():
    n, hits = 4000, [0, 0, 0]
    units = [(0, 10.0, 0.2), (1, 90.0, 0.5), (2, 35.0, 0.7)]
    for seed in range(n):
        decided, left = pivot(iter(units), seed)
        if left:
            decided.append((left[0], int(_uniform(seed, left[0], left[0]) < left[2])))
        for i, x in decided:
            hits[i] += x
    assert [h / n for h in hits] == pytest.approx([0.2, 0.5, 0.7], abs=0.035)


SCHEMA = "doc_id long, source string, text string, n_tokens int"


def test_mix_sources(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["big", "big", "big", "small", None, "none"]), "word " * rng.randint(1, 30), 0) for i in range(1500)]
    rows += [(9001, "big", None, 0), (9002, "small", "", 0), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA)
    targets = spark.createDataFrame([("big", 0.6, 2), ("small", 0.2, 2), ("absent", 0.2, 2), ("small", 0.2, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    copies, plan = mix_sources(docs, targets)
    got = copies.collect()
    assert len(got) == 1502 and len({r.doc_id for r in got}) == 1502
    most = {"big": 2, "small": 2}
    assert all(0 <= r.copies <= most.get(r.source, 0) for r in got)
    assert all(r.copies == 0 for r in got if not r.n_tokens or r.source not in most)
    for s in plan.collect():
        size = sum(r.n_tokens for r in got if r.source == s.source)
        reached = sum(r.n_tokens * r.copies for r in got if r.source == s.source)
        assert abs(reached - s.expected_copies * size) <= max(r.n_tokens for r in got if r.source == s.source)
    report = {r.source: r for r in mixture_report(copies, targets, plan).collect()}
    assert set(report) == {"big", "small", "absent", "none", None}
    assert report["big"].share_reached == pytest.approx(0.75, abs=0.01) and report["absent"].share_reached == 0.0
    # the same again: draws depend on documents only
    assert sorted(map(tuple, mix_sources(docs.repartition(3), targets)[0].collect()), key=str) == sorted(map(tuple, got), key=str)


def test_nothing_to_mix(spark):
    docs = spark.createDataFrame([(1, "a", "x y", 0)], SCHEMA)
    none = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    copies, plan = mix_sources(docs, none)
    assert [r.copies for r in copies.collect()] == [0] and plan.count() == 0 and mixture_report(copies, none, plan).count() == 1
    assert mix_sources(docs.where("false"), none)[0].count() == 0


def test_rows_of_one_id_that_differ(spark):
    """A conflicting id multiplies nothing: each different row is a document of its own."""
    rows = [(1, "a", "one two", 0), (1, "a", "three four five", 0), (1, "b", "one two", 0), (2, "a", "six", 0), (2, "a", "six", 0), (1, None, "one two", 0)]
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    got = mix_sources(spark.createDataFrame(rows, SCHEMA), targets)[0].collect()
    assert sorted((r.doc_id, r.source or "", r.n_tokens) for r in got) == [(1, "", 2), (1, "a", 2), (1, "a", 3), (1, "b", 2), (2, "a", 1)]


def test_many_sources(spark):
    """No cap on the number of sources."""
    docs = spark.range(12_000).selectExpr("id as doc_id", "concat('s', id) as source", "'one two' as text", "0 as n_tokens")
    targets = spark.range(12_000).selectExpr("concat('s', id) as source", "1.0 / 12000 as target_share", "2 as max_repeats")
    copies, plan = mix_sources(docs, targets)
    assert plan.count() == 12_000 and {r.copies for r in copies.select("copies").distinct().collect()} == {2}
