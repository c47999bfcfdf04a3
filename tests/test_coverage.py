import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from meridian.operators.coverage import coverage_summary, periods_and_gaps

SCHEMA = "cik long, member_from date, member_to date, kind string, start_date string"
D = date(2020, 1, 1)


def day(n):
    return None if n is None else D + timedelta(n)


def run(spark, rows):
    df = spark.createDataFrame([(k, day(a), day(b), "x", "y") for k, a, b in rows], SCHEMA)
    out = periods_and_gaps(df, "cik", "member_from", "member_to").collect()
    back = lambda d: None if d is None else (d - D).days
    return sorted(((r.cik, r.kind, back(r.start_date), back(r.end_date)) for r in out), key=str)


def brute(rows):
    """Day by day over a small calendar; 500 stands for an open end."""
    out = []
    for k in {k for k, *_ in rows}:
        spells = [(a, 500 if b is None else b) for q, a, b in rows if q == k and a is not None and (b is None or b > a)]
        on = [any(a <= d < b for a, b in spells) for d in range(-5, 500)]
        edges = [i - 5 for i in range(1, len(on)) if on[i] != on[i - 1]]
        for i in range(0, len(edges), 2):
            end = edges[i + 1] if i + 1 < len(edges) else None
            out.append((k, "period", edges[i], end))
            if end is not None and i + 2 < len(edges):
                out.append((k, "gap", end, edges[i + 2]))
    return sorted(out, key=str)


def test_touching_nested_inverted_open(spark):
    rows = [(1, 0, 10), (1, 10, 20), (1, 30, 40), (1, 31, 33), (1, 50, 45), (1, 60, 60), (1, None, 9), (1, 70, None), (2, 5, None), (2, 1, 2), (3, 9, 3)]
    assert run(spark, rows + rows) == brute(rows)


def test_null_key_is_a_group_and_empty_table(spark):
    assert run(spark, [(None, 0, 2), (None, 3, 4)]) == [(None, "gap", 2, 3), (None, "period", 0, 2), (None, "period", 3, 4)]
    assert run(spark, []) == []


def test_random_against_day_by_day(spark):
    rng = random.Random(5)
    rows = []
    for k in range(40):
        for _ in range(rng.randint(0, 12)):
            a = rng.randint(0, 120)
            rows.append((k, a if rng.random() > 0.1 else None, None if rng.random() < 0.08 else a + rng.randint(-5, 30)))
    assert run(spark, rows) == brute(rows)


def test_hot_key_is_bounded_by_the_calendar(spark):
    n = spark.range(50_000).select(F.lit(7).cast("long").alias("cik"), F.expr("date_add(date'2020-01-01', cast(id % 900 as int))").alias("member_from"))
    df = n.withColumn("member_to", F.date_add("member_from", 1))
    out = periods_and_gaps(df, "cik", "member_from", "member_to").collect()
    assert [(r.kind, (r.end_date - r.start_date).days) for r in out] == [("period", 900)]


def test_summary(spark):
    df = spark.createDataFrame([(1, day(0), day(3)), (1, day(5), None)], "cik long, member_from date, member_to date")
    r = coverage_summary(df, "cik", "member_from", "member_to").first()
    assert (r.n_periods, r.n_gaps, r.days_covered, r.days_in_gaps, r.is_open) == (2, 1, 3, 2, True)
