import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.operators import boosting as bo

SCHEMA = "fold int, role string, id long, y double, a double, b double, extra string"


def rows_of(seed, n=300):
    rng = random.Random(seed)
    out = []
    for fold in (1, 2):
        for i in range(n):
            a = None if rng.random() < 0.1 else rng.choice([0.0, 1.0, 2.0, 5.0, rng.random()])
            b = float("nan") if rng.random() < 0.05 else rng.gauss(0, 1)
            y = None if rng.random() < 0.05 else (a or 0.0) * 2 + (3.0 if b == b and b > 0.3 else 0.0) + rng.gauss(0, 0.1)
            out.append((fold, "test" if i % 5 == 0 else "train", fold * 10_000 + i, y, a, b, "x"))
    return out


def tree(x, y, depth, l2):
    """A tree by trying every split of every feature over single rows; gives a function of a row."""
    n, g = len(y), sum(y)
    best = None
    if depth:
        for f in range(len(x[0]) if x else 0):
            for cut in sorted({r[f] for r in x})[:-1]:
                left = [v for r, v in zip(x, y) if r[f] <= cut]
                gain = sum(left) ** 2 / (len(left) + l2) + (g - sum(left)) ** 2 / (n - len(left) + l2) - g**2 / (n + l2)
                if gain > 1e-12 * max(abs(g), 1.0) and (best is None or gain > best[0] + 1e-12):
                    best = (gain, f, cut)
    if best is None:
        return lambda r: g / (n + l2)
    _, f, cut = best
    sides = [tree(*map(list, zip(*[(r, v) for r, v in zip(x, y) if (r[f] <= cut) == low])), depth - 1, l2) for low in (True, False)]
    return lambda r: sides[0 if r[f] <= cut else 1](r)


def test_trees_over_cells_are_those_over_rows(spark):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.fold, r.id): r.prediction for r in bo.boosted_predictions(df, ["a", "b"], "y", "id", bins=6, rounds=4, depth=2).collect()}
    binned = bo._binned(df, ["a", "b"], 6).collect()
    for fold in (1, 2):
        train = [r for r in binned if r.fold == fold and r.role == "train" and r.y is not None]
        test = [r for r in binned if r.fold == fold and r.role == "test"]
        x, y = [r["_b"] for r in train], [r.y for r in train]
        value = {r.id: sum(y) / len(y) for r in train + test}
        for _ in range(4):
            step = tree(x, [v - value[r.id] for r, v in zip(train, y)], 2, 1.0)
            for r in train + test:
                value[r.id] += 0.2 * step(r["_b"])
        assert {r.id: got[fold, r.id] for r in test} == pytest.approx({r.id: value[r.id] for r in test})
    assert len(got) == sum(r[1] == "test" for r in rows)


def test_importance_is_the_mean_over_exchanges(spark):
    df = spark.createDataFrame(rows_of(2, 120), SCHEMA)
    got = {(r.fold, r.feature): (r.gain, r.permutation_loss) for r in bo.feature_importance(df, ["a", "b"], "y", bins=4, rounds=5, depth=2).collect()}
    binned = bo._binned(df, ["a", "b"], 4).collect()
    train = [r for r in binned if r.fold == 1 and r.role == "train" and r.y is not None]
    test = [r for r in binned if r.fold == 1 and r.role == "test" and r.y is not None]
    value = sum(r.y for r in train) / len(train)
    trees, now = [], {r.id: value for r in train}
    for _ in range(5):
        t = tree([r["_b"] for r in train], [r.y - now[r.id] for r in train], 2, 1.0)
        trees.append(t)
        now = {r.id: now[r.id] + 0.2 * t(r["_b"]) for r in train}
    predict = lambda b: value + 0.2 * sum(t(b) for t in trees)
    own = np.mean([(r.y - predict(r["_b"])) ** 2 for r in test])
    for i, f in enumerate(("a", "b")):
        mixed = [(r.y - predict([q["_b"][i] if k == i else v for k, v in enumerate(r["_b"])])) ** 2 for r in test for q in test]
        assert got[1, f][1] == pytest.approx(np.mean(mixed) - own, abs=1e-9) and got[1, f][0] > 0


def test_order_seeds_and_odd_input(spark):
    rows = rows_of(3, 80)
    df = spark.createDataFrame(rows, SCHEMA)
    one = sorted(map(tuple, bo.boosted_predictions(df, ["a", "b"], "y", "id", bins=5, share=0.5, seed=7, rounds=5).collect()))
    two = sorted(map(tuple, bo.boosted_predictions(df.repartition(5), ["a", "b"], "y", "id", bins=5, share=0.5, seed=7, rounds=5).collect()))
    assert [p for *_, p in one] == pytest.approx([p for *_, p in two])
    assert bo.boosted_predictions(df.where("false"), ["a"], "y", "id").count() == 0
    assert bo.boosted_predictions(df.where("role = 'test'"), ["a"], "y", "id").count() == 0
    assert bo.boosted_predictions(df.where("role = 'train'"), ["a"], "y", "id").count() == 0 and bo.feature_importance(df.where("role = 'train'"), ["a"], "y").count() == 0
    same = bo.boosted_predictions(df.withColumn("a", F.lit(1.0)).withColumn("y", F.lit(2.0)), ["a"], "y", "id").collect()
    assert {round(r.prediction, 9) for r in same} == {2.0}
    with pytest.raises(ValueError):
        bo.boosted_predictions(df, ["a"] * 8, "y", "id")
