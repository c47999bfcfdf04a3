"""Boosted regression trees per fold, fitted from the sums of binned cells.

Features are cut at quantiles of the training rows of each fold. With squared
loss all that the trees depend on is, for every distinct combination of bins,
the number of rows and the sum of their targets. So rows are aggregated to such
cells before the shuffle, and the group that a fold is fitted in holds cells, of
which there are at most ``(bins + 2) ** features``, however many rows there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridian.session import checkpointed

MOST_CELLS = 2_000_000


def grown(x: np.ndarray, n: np.ndarray, g: np.ndarray, depth: int, l2: float, use: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """Step of every cell by one tree on the gradient sums ``g``; the gain of each split is added to ``gains``.

    Splits are the best of all (feature, bin) pairs, the first of equal ones.
    Cells without rows are led through the tree like others.
    """
    step = np.zeros(len(n))
    todo = [(np.arange(len(n)), depth)]
    while todo:
        cells, left = todo.pop()
        whole_n, whole_g = n[cells].sum(), g[cells].sum()
        best = (1e-12 * max(abs(whole_g), 1.0), -1, 0)
        for f in use if left else ():
            hn = np.cumsum(np.bincount(x[cells, f], n[cells]))[:-1]
            hg = np.cumsum(np.bincount(x[cells, f], g[cells]))[:-1]
            if not len(hn):
                continue
            gain = hg**2 / (hn + l2) + (whole_g - hg) ** 2 / (whole_n - hn + l2) - whole_g**2 / (whole_n + l2)
            gain[(hn <= 0) | (hn >= whole_n)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], int(f), k)
        if best[1] < 0:
            step[cells] = whole_g / (whole_n + l2)
            continue
        gains[best[1]] += best[0]
        low = x[cells, best[1]] <= best[2]
        todo += [(cells[low], left - 1), (cells[~low], left - 1)]
    return step


def boosted(x: np.ndarray, n: np.ndarray, s: np.ndarray, *, rounds: int, depth: int, rate: float, l2: float, share: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``(value of every cell, gain of every feature)`` from cells of bins ``x`` with ``n`` rows and target sums ``s``."""
    k = x.shape[1]
    rng = np.random.default_rng(seed)
    value = np.full(len(n), s.sum() / max(n.sum(), 1))
    gains = np.zeros(k)
    for _ in range(rounds):
        use = np.sort(rng.choice(k, max(1, round(share * k)), replace=False)) if share < 1 else np.arange(k)
        value = value + rate * grown(x, n, s - n * value, depth, l2, use, gains)
    return value, gains


def _binned(folds: DataFrame, features: list[str], bins: int) -> DataFrame:
    """``folds`` with ``_b``: the bin of each feature by quantiles of the fold's training rows; a missing value has the last one."""
    if (bins + 2) ** len(features) > MOST_CELLS:
        raise ValueError(f"{len(features)} features of {bins} bins have more than {MOST_CELLS} cells; take fewer bins")
    probabilities = [i / bins for i in range(1, bins)]
    train = folds.where(F.col("role") == "train")
    cuts = train.groupBy("fold").agg(*(F.array_distinct(F.percentile_approx(F.nanvl(F.col(f).cast("double"), F.lit(None)), probabilities, 100_000)).alias(f"_q{i}") for i, f in enumerate(features)))
    cuts = F.broadcast(cuts)  # a row for each fold, of which the calendar bounds the number

    def place(i: int, f: str):
        v = F.nanvl(F.col(f).cast("double"), F.lit(None))
        return F.when(v.isNull(), bins + 1).otherwise(F.size(F.filter(F.coalesce(f"_q{i}", F.array().cast("array<double>")), lambda c: c < v)))

    return folds.join(cuts, "fold").withColumn("_b", F.array(*(place(i, f) for i, f in enumerate(features))))


_PARAMETERS = {"rounds": 30, "depth": 3, "rate": 0.2, "l2": 1.0, "share": 1.0, "seed": 0}


def _fitted(binned: DataFrame, target: str, names: list[str], parameters: dict) -> DataFrame:
    """``(fold, _b, prediction, gain, loss)`` of the test cells of each fold; ``gain`` and ``loss`` per feature are the same for all of a fold."""
    y = F.col(target).cast("double")
    fine = y.isNotNull() & ~F.isnan(y)
    train, test = (F.col("role") == "train") & fine, F.col("role") == "test"
    cells = binned.where(train | test).groupBy("fold", "_b").agg(
        F.count_if(train).alias("n"), F.coalesce(F.sum(F.when(train, y)), F.lit(0.0)).alias("s"), F.count_if(test).alias("asked"),
        F.count_if(test & fine).alias("m"), F.coalesce(F.sum(F.when(test & fine, y)), F.lit(0.0)).alias("t"),
    )
    schema = T.StructType([
        binned.schema["fold"], T.StructField("_b", T.ArrayType(T.IntegerType())), T.StructField("prediction", T.DoubleType()),
        T.StructField("gain", T.ArrayType(T.DoubleType())), T.StructField("loss", T.ArrayType(T.DoubleType())),
    ])
    options = _PARAMETERS | parameters

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.lexsort(np.stack(pdf["_b"].to_list()).T[::-1])]
        x = np.stack(pdf["_b"].to_list()).astype(np.int64)
        n, s, m, t = (pdf[c].to_numpy(dtype=float) for c in ("n", "s", "m", "t"))
        asked = pdf["asked"].to_numpy() > 0
        loss = np.zeros(x.shape[1])
        rows = len(x)
        if m.sum():
            # every test cell with the bin of one feature exchanged for each one that occurs, weighted by how often it does
            spare, source = [], []
            for f in range(x.shape[1]):
                weight = np.bincount(x[:, f], m)
                for v in np.flatnonzero(weight):
                    other = x[m > 0].copy()
                    other[:, f] = v
                    spare.append(other)
                    source.append((f, weight[v] / m.sum()))
            x = np.concatenate([x, *spare])
            zero = np.zeros(len(x) - rows)
            n, s = np.concatenate([n, zero]), np.concatenate([s, zero])
        value, gains = boosted(x, n, s, **options)
        if m.sum():
            mm, tt = m[m > 0], t[m > 0]
            error = lambda p: float((mm * p * p - 2 * tt * p).sum() / mm.sum())  # noqa: E731  # up to the squares of the targets
            own = error(value[:rows][m > 0])
            for i, (f, weight) in enumerate(source):
                at = rows + i * len(mm)
                loss[f] += weight * (error(value[at : at + len(mm)]) - own)
        out = pd.DataFrame({"fold": pdf["fold"], "_b": pdf["_b"], "prediction": value[:rows]})[asked]
        every = lambda x: pd.Series([x.tolist()] * len(out), index=out.index, dtype=object)  # noqa: E731  # lists even where no row is asked for
        return out.assign(gain=every(gains), loss=every(loss))

    return cells.groupBy("fold").applyInPandas(fit, schema)


def boosted_predictions(folds: DataFrame, features: list[str], target: str, row: str, *, bins: int = 16, **parameters) -> DataFrame:
    """``(fold, row, prediction)`` of boosted trees fitted on each fold's training rows.

    ``folds`` as from ``walk_forward``. Training rows without a target don't
    count; missing features have a bin of their own; a fold without training
    rows has no cuts and no predictions. ``parameters``: rounds, depth, rate,
    l2, share (of the features that a tree may use) and seed.
    """
    binned = checkpointed(_binned(folds.select("fold", "role", row, target, *features), features, bins))
    found = _fitted(binned, target, features, parameters).select("fold", "_b", "prediction")
    return binned.where("role = 'test'").join(found, ["fold", "_b"]).select("fold", row, "prediction")


def feature_importance(folds: DataFrame, features: list[str], target: str, *, bins: int = 16, **parameters) -> DataFrame:
    """``(fold, feature, gain, permutation_loss)``: summed gain of a feature's splits, and how much the mean squared error of the
    test rows rises if its values are permuted: the exact mean over all permutations with repetition, so nothing is drawn."""
    binned = _binned(folds.select("fold", "role", target, *features), features, bins)
    per = _fitted(binned, target, features, parameters).groupBy("fold").agg(F.first("gain").alias("g"), F.first("loss").alias("l"))
    each = F.array(*(F.struct(F.lit(f).alias("feature"), F.col("g")[i].alias("gain"), F.col("l")[i].alias("permutation_loss")) for i, f in enumerate(features)))
    return per.select("fold", F.explode(each).alias("x")).select("fold", "x.*")
