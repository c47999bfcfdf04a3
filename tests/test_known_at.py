import random
from datetime import date, timedelta

import pytest

from meridian.operators.known_at import known_states, with_known

D = date(2020, 1, 1)
ARGS = {"entity": "cik", "at": "filing_date", "effective": "instant", "disclosed": "filed", "source": "accn", "value": "val"}
EVENT, FACT = "id string, cik long, filing_date date, val double", "cik long, instant date, filed date, accn string, val double, id int"


def day(n):
    return None if n is None else D + timedelta(n)


def frames(spark, events, facts):
    e = spark.createDataFrame([(i, k, day(d), -1.0) for i, k, d in events], EVENT)
    f = spark.createDataFrame([(k, day(a), day(b), s, v, 0) for k, a, b, s, v in facts], FACT)
    return e, f


def brute(events, facts):
    out = {}
    for i, k, d in events:
        known = [(a, b, s or "", v) for q, a, b, s, v in facts if None not in (k, d, a, b) and q == k and a < d and b < d]
        best = max(known, default=None)
        out[i] = best and (best[0], best[1], best[2] or None, best[3])
    return out


def run(spark, events, facts):
    rows = with_known(*frames(spark, events, facts), **ARGS, buckets=5).collect()
    back = lambda d: (d - D).days
    return {r.id: None if r.known_effective is None else (back(r.known_effective), back(r.known_disclosed), r.known_source, r.known_val) for r in rows}


def test_strictly_before_late_facts_ties_and_nulls(spark):
    events = [("a", 1, 10), ("b", 1, 11), ("c", 1, None), ("d", None, 10), ("e", 2, 5), ("f", 3, 100)]
    facts = [(1, 5, 10, "x", 1.0), (1, 4, 6, "y", 2.0), (1, 4, 6, "z", 0.0), (1, 4, 6, "z", 0.0), (2, 5, 1, "x", 3.0), (2, 1, None, "q", 4.0), (3, 9, 9, None, 7.0), (None, 1, 1, "n", 1.0)]
    got = run(spark, events, facts)
    assert got == brute(events, facts)
    assert got["a"] == (4, 6, "z", 0.0) and got["b"] == (5, 10, "x", 1.0) and got["e"] is None and got["f"][2] is None


def test_random_against_brute_force(spark):
    rng = random.Random(3)
    events = [(str(i), rng.choice([1, 1, 1, 2, 3, 4]), rng.randint(0, 60)) for i in range(300)]
    facts = [(rng.choice([1, 1, 2, 3]), rng.randint(0, 60), rng.choice([None, *range(60)]), rng.choice("pqr"), float(rng.randint(0, 4))) for _ in range(200)]
    assert run(spark, events, facts) == brute(events, facts)


def test_empty_tables_and_repeated_events(spark):
    assert run(spark, [("a", 1, 3)], []) == {"a": None}
    assert run(spark, [], [(1, 1, 1, "x", 1.0)]) == {}
    e, f = frames(spark, [("a", 1, 3), ("a", 1, 3)], [(1, 1, 1, "x", 1.0)])
    assert with_known(e, f, **ARGS).count() == 2
    assert known_states(e, f, **ARGS).count() == 1


def test_clashing_names(spark):
    e, f = frames(spark, [("a", 1, 3)], [(1, 1, 1, "x", 1.0)])
    with pytest.raises(ValueError):
        with_known(e.withColumnRenamed("id", "known_val"), f, **ARGS)
    assert with_known(e.withColumnRenamed("id", "source"), f, **ARGS).first().known_source == "x"
