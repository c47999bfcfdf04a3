"""Walk-forward folds, leakage checks and small models that are fitted per fold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quarter_index(day: Column) -> Column:
    return F.year(day) * 4 + F.quarter(day) - 1


def quarter_start(index: Column) -> Column:
    return F.make_date(F.floor(index / 4).cast("int"), (F.pmod(index, F.lit(4)) * 3 + 1).cast("int"), F.lit(1))


def walk_forward(rows: DataFrame, day: str, *, closes: str | None = None, window: int | None = None, first: int | None = None) -> DataFrame:
    """``rows`` once per fold and role: ``fold`` (quarter index of the test rows) and ``role`` (``train`` or ``test``).

    Test rows are those of one quarter. Training rows come before its start,
    from any time or from the ``window`` quarters before it. With ``closes``,
    training rows whose outcome closes on or after the start are purged; a null
    close is kept. Quarters before ``first`` and without training rows are no
    folds. The folds are the quarters present, as many as the calendar has; each
    row is copied to the folds it trains, without a join.
    """
    q = rows.where(F.col(day).isNotNull()).withColumn("_q", quarter_index(F.col(day)))
    folds = q.select(F.col("_q").alias("fold")).distinct()
    if first is not None:
        folds = folds.where(F.col("fold") >= first)
    quarters = F.array(*(F.lit(r["fold"]) for r in folds.orderBy("fold").collect())).cast("array<int>")
    later = F.filter(quarters, lambda x: (x > F.col("_q")) & (x <= F.col("_q") + window if window is not None else F.lit(True)))
    train = q.withColumn("fold", F.explode(later))
    if closes is not None:
        train = train.where(F.col(closes).isNull() | (F.col(closes) < quarter_start(F.col("fold"))))
    usable = train.select("fold").distinct()  # no more than quarters
    test = q.withColumn("fold", F.col("_q")).join(F.broadcast(usable), "fold", "left_semi")
    return train.withColumn("role", F.lit("train")).unionByName(test.withColumn("role", F.lit("test")).select(*train.columns, "role")).drop("_q")


def fold_census(folds: DataFrame, day: str) -> DataFrame:
    """``(fold, n_train, n_test, leaks)``: rows per role, and training rows that are not before every test row."""
    s = folds.groupBy("fold").agg(
        F.count_if(F.col("role") == "train").alias("n_train"),
        F.count_if(F.col("role") == "test").alias("n_test"),
        F.count_if((F.col("role") == "train") & (quarter_index(F.col(day)) >= F.col("fold"))).alias("leaks"),
    )
    return s


def group_mean_prediction(folds: DataFrame, group: str, target: str, row: str) -> DataFrame:
    """``(fold, row, prediction)``: the training mean of the test row's group, or of all training rows for a group not seen."""
    train = folds.where((F.col("role") == "train") & F.col(target).isNotNull())
    by = train.groupBy("fold", group).agg(F.avg(target).alias("_g"))
    overall = train.groupBy("fold").agg(F.avg(target).alias("_a"))
    test = folds.where(F.col("role") == "test").select("fold", group, row)
    return test.join(overall, "fold", "left").join(by, ["fold", group], "left").select("fold", row, F.coalesce("_g", "_a").alias("prediction"))


def ridge_predictions(folds: DataFrame, features: list[str], target: str, row: str, l2: float = 1.0) -> DataFrame:
    """``(fold, row, prediction)`` of a ridge regression on standardised features, fitted per fold.

    Only sums per fold (a vector and a matrix as wide as the features) are
    gathered for the fit: rows stay where they are. Missing features are set to
    the training mean; a feature without variance counts for nothing.
    """
    train = folds.where((F.col("role") == "train") & F.col(target).isNotNull())
    x = [F.col(f).cast("double") for f in features]
    stats = train.groupBy("fold").agg(
        *(F.avg(c).alias(f"_m{i}") for i, c in enumerate(x)), *(F.stddev_pop(c).alias(f"_s{i}") for i, c in enumerate(x)), F.avg(target).alias("_y"), F.count("*").alias("_n")
    )
    scaled = folds.join(stats, "fold").select(
        "fold", "role", row, (F.col(target) - F.col("_y")).alias("_t"), "_y",
        *(F.coalesce(F.try_divide(c - F.col(f"_m{i}"), F.nullif(F.col(f"_s{i}"), F.lit(0.0))), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(x)),
    )
    k = len(features)
    on = F.col("role") == "train"
    sums = scaled.where(on & F.col("_t").isNotNull()).groupBy("fold").agg(
        F.array(*(F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")) for i in range(k) for j in range(k))).alias("xx"),
        F.array(*(F.sum(F.col(f"_x{i}") * F.col("_t")) for i in range(k))).alias("xy"),
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        w = [np.linalg.solve(np.array(a).reshape(k, k) + l2 * np.eye(k), np.array(b)) for a, b in zip(pdf["xx"], pdf["xy"])]
        return pd.DataFrame({"fold": pdf["fold"], "w": w})

    weights = sums.mapInPandas(lambda it: (solve(p) for p in it), T.StructType([folds.schema["fold"], T.StructField("w", T.ArrayType(T.DoubleType()))]))
    test = scaled.where(~on).join(weights, "fold")
    dot = sum((F.col(f"_x{i}") * F.col("w")[i] for i in range(k)), F.col("_y"))
    return test.select("fold", row, dot.alias("prediction"))


def pooled_mean(vectors: DataFrame, group: list[str], vector: str) -> DataFrame:
    """``(group, dim, mean)``: mean vector of each group, dimension by dimension."""
    parts = vectors.select(*group, F.posexplode(vector).alias("dim", "_v"))
    return parts.groupBy(*group, "dim").agg(F.avg("_v").alias("mean"))


def principal_axes(vectors: DataFrame, vector: str, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the first k principal axes, each with its largest loading positive.

    The products are summed in the partitions, and those sums by place of the
    matrix: one ``width`` x ``width`` matrix reaches the driver, whatever the
    number of rows and partitions.
    """
    per = _moments(vectors.select(F.lit(0).alias("fold"), F.col(vector).alias("v")), width)
    got = {r["i"]: r["s"] for r in per.collect()}
    return _axes(np.array([got.get(i, 0.0) for i in range(1 + width + width * width)]), width, k)


def _moments(vectors: DataFrame, width: int) -> DataFrame:
    """``(fold, i, s)``: number, sum and products of the vectors of each fold, place by place. Vectors of another width don't count."""

    def sums(batches):
        of: dict = {}
        for batch in batches:
            for fold, part in batch.groupby("fold"):
                x = [v for v in part["v"] if v is not None and len(v) == width]
                if x:
                    m = np.asarray(x, dtype=float)
                    of[fold] = of.get(fold, 0) + np.concatenate([[len(m)], m.sum(axis=0), (m.T @ m).ravel()])
        if of:
            yield pd.DataFrame({"fold": list(of), "s": [s.tolist() for s in of.values()]})

    parts = vectors.select("fold", "v").mapInPandas(sums, T.StructType([vectors.schema["fold"], T.StructField("s", T.ArrayType(T.DoubleType()))]))
    return parts.select("fold", F.posexplode("s").alias("i", "s")).groupBy("fold", "i").agg(F.sum("s").alias("s"))


def _axes(sums: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    n, s, q = sums[0], sums[1 : 1 + width], sums[1 + width :].reshape(width, width)
    mean = s / max(n, 1)
    values, axes = np.linalg.eigh(q / max(n, 1) - np.outer(mean, mean))
    axes = axes[:, np.argsort(-values)[:k]].T
    return mean, axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]


def fold_axes(folds: DataFrame, row: str, vector: str, width: int, k: int) -> DataFrame:
    """``(fold, row, pc)``: coordinates of each fold's test rows along the axes of its training rows alone.

    A fold's fit holds one matrix. A null vector or one of another width has a
    null; folds without training vectors have no rows.
    """
    per = _moments(folds.where("role = 'train'").select("fold", F.col(vector).alias("v")), width)
    schema = T.StructType([folds.schema["fold"], T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("axes", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        mean, axes = _axes(pdf.sort_values("i")["s"].to_numpy(), width, k)
        return pd.DataFrame({"fold": [pdf["fold"].iloc[0]], "mean": [mean.tolist()], "axes": [axes.tolist()]})

    fits = per.groupBy("fold").applyInPandas(fit, schema)
    test = folds.where("role = 'test'").join(F.broadcast(fits), "fold")  # a row for each fold
    centred = F.zip_with(vector, "mean", lambda v, m: v.cast("double") - m)
    pc = F.transform("axes", lambda a: F.aggregate(F.zip_with(centred, a, lambda v, w: v * w), F.lit(0.0), lambda s, x: s + x))
    return test.select("fold", row, F.when(F.size(vector) == width, pc).alias("pc"))


def projected(vectors: DataFrame, key: str, vector: str, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """``(key, pc)``: coordinates along the axes; null for a null vector or one of another width."""

    def run(batches):
        for batch in batches:
            out = [None if v is None or len(v) != len(mean) else ((np.asarray(v, dtype=float) - mean) @ axes.T).tolist() for v in batch[vector]]
            yield pd.DataFrame({key: batch[key], "pc": out})

    schema = T.StructType([vectors.schema[key], T.StructField("pc", T.ArrayType(T.DoubleType()))])
    return vectors.select(key, vector).mapInPandas(run, schema)


def bootstrap_mean_sd(values: list[float], length: int, resamples: int = 1000, seed: int = 0) -> float | None:
    """Standard deviation of the mean under a moving-block bootstrap; for a value per fold, which the driver holds.

    A resample is as long as the series: whole blocks, and a shorter last one.
    Sums of blocks are differences of running sums.
    """
    n = len(values)
    if n < 2:
        return None
    size = sorted((1, length, n))[1]
    running = np.concatenate([[0.0], np.cumsum(values)])
    widths = np.append(np.repeat(size, (n - 1) // size), (n - 1) % size + 1)
    first = np.random.default_rng(seed).integers(n - size, endpoint=True, size=(len(widths), resamples))
    return float(np.std((running[first + widths[:, None]] - running[first]).sum(axis=0) / n, ddof=1))


def block_length(values: list[float]) -> int:
    """``ceil(cbrt(n * (2 r / (1 - r)) ** 2))`` with the lag-one autocorrelation r, at most 0.99; from 1 to n.

    So 1 where r is not positive, or cannot be told from fewer than three or from equal values.
    """
    n = len(values)
    if n < 3 or np.ptp(values) == 0:
        return 1
    own, next_one = np.correlate(centred := np.subtract(values, np.mean(values)), centred, "full")[n - 1 : n + 1]
    r = np.clip(next_one / own, 0.0, 0.99)
    return int(np.clip(np.ceil(np.cbrt(n * (2 * r / (1 - r)) ** 2)), 1, n))
