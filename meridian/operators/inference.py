"""Estimators whose inner loops run over sums per cluster or partition."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.session import checkpointed


def wild_cluster_p(rows: DataFrame, x: str, y: str, cluster: str, draws: int = 999, seed: int = 0) -> dict:
    """Slope of y on x, and its p-value under a wild cluster bootstrap with the null imposed.

    Residuals of the mean are flipped by one sign per cluster and draw. A
    cluster counts through one sum; signs come from a hash of the cluster, so
    partitions add up vectors as long as the number of draws and nothing else.
    Null without two clusters or without variance of x.
    """
    full = rows.where(" and ".join(f"`{c}` is not null" for c in (x, y, cluster))).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(cluster).cast("string").alias("c"))
    m = full.agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).first()
    if not m["n"]:
        return {"slope": None, "p": None, "n_clusters": 0}
    dx = F.col("x") - F.lit(m["x"])
    sums = full.groupBy("c").agg(F.sum(dx * (F.col("y") - F.lit(m["y"]))).alias("s"), F.sum(dx * dx).alias("q"))

    def flipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, s, q, n = np.zeros(draws), 0.0, 0.0, 0
        for batch in batches:
            for c, a, b in zip(batch["c"], batch["s"], batch["q"]):
                rng = np.random.default_rng(xxhash.xxh64_intdigest(f"{seed}|{c}"))
                total += np.where(rng.random(draws) < 0.5, -1.0, 1.0) * a
                s, q, n = s + a, q + b, n + 1
        yield pd.DataFrame({"v": [total.tolist()], "s": [s], "q": [q], "n": [n]})

    total, s, q, n = np.zeros(draws), 0.0, 0.0, 0
    for r in sums.mapInPandas(flipped, "v array<double>, s double, q double, n long").toLocalIterator():
        total, s, q, n = total + np.array(r["v"]), s + r["s"], q + r["q"], n + r["n"]
    if n < 2 or q <= 0:
        return {"slope": None, "p": None, "n_clusters": n}
    hits = int((np.abs(total) >= abs(s) - 1e-12).sum())
    return {"slope": s / q, "p": (1 + hits) / (1 + draws), "n_clusters": n}


def cluster_bootstrap(rows: DataFrame, cluster: str, numerator: str, denominator: str, draws: int = 1000, seed: int = 0, level: float = 0.95) -> dict:
    """Ratio of two sums with a percentile interval over resampled clusters, by Poisson weights drawn from a hash of the cluster."""
    sums = rows.where(F.col(cluster).isNotNull()).groupBy(F.col(cluster).cast("string").alias("c")).agg(
        F.coalesce(F.sum(numerator), F.lit(0)).cast("double").alias("a"), F.coalesce(F.sum(denominator), F.lit(0)).cast("double").alias("b")
    )

    def weighted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros(draws + 1), np.zeros(draws + 1)
        for batch in batches:
            for c, x, y in zip(batch["c"], batch["a"], batch["b"]):
                w = np.r_[1, np.random.default_rng(xxhash.xxh64_intdigest(f"{seed}|{c}")).poisson(1.0, draws)]
                a, b = a + w * x, b + w * y
        yield pd.DataFrame({"a": [a.tolist()], "b": [b.tolist()]})

    a, b = np.zeros(draws + 1), np.zeros(draws + 1)
    for r in sums.mapInPandas(weighted, "a array<double>, b array<double>").toLocalIterator():
        a, b = a + np.array(r["a"]), b + np.array(r["b"])
    if b[0] == 0:
        return {"rate": None, "lower": None, "upper": None}
    with np.errstate(divide="ignore", invalid="ignore"):
        r = a[1:] / b[1:]
    lo, hi = np.nanquantile(r[b[1:] > 0], [(1 - level) / 2, (1 + level) / 2])
    return {"rate": a[0] / b[0], "lower": float(lo), "upper": float(hi)}


def logistic_l2(rows: DataFrame, features: list[str], label: str, l2: float = 1.0, most_rounds: int = 25, tol: float = 1e-8) -> np.ndarray:
    """Coefficients of a ridge logistic regression, the intercept first and not penalised, by iterated reweighted least squares.

    Each round adds up one gradient and one matrix per partition. Rows with a
    null are left out; they are written to the checkpoint folder once. A fit
    that has not converged after ``most_rounds`` is an error.
    """
    k = len(features) + 1
    full = rows.where(" and ".join(f"`{c}` is not null" for c in [*features, label]))
    data = checkpointed(full.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)), F.col(label).cast("double").alias("y")))
    beta = np.zeros(k)
    penalty = l2 * np.eye(k)
    penalty[0, 0] = 0.0
    for _ in range(most_rounds):

        def sums(batches: Iterator[pd.DataFrame], beta=beta) -> Iterator[pd.DataFrame]:
            g, h = np.zeros(k), np.zeros((k, k))
            for batch in batches:
                m = np.c_[np.ones(len(batch)), batch.drop(columns="y").to_numpy(dtype=float)]
                p = 1 / (1 + np.exp(-np.clip(m @ beta, -35, 35)))
                g += m.T @ (batch["y"].to_numpy() - p)
                h += (m * (p * (1 - p))[:, None]).T @ m
            yield pd.DataFrame({"g": [g.tolist()], "h": [h.ravel().tolist()]})

        g, h = np.zeros(k), np.zeros((k, k))
        for r in data.mapInPandas(sums, "g array<double>, h array<double>").toLocalIterator():
            g, h = g + np.array(r["g"]), h + np.array(r["h"]).reshape(k, k)
        step = np.linalg.lstsq(h + penalty, g - penalty @ beta, rcond=None)[0]
        beta = beta + step
        if np.abs(step).max() < tol:
            return beta
    raise RuntimeError(f"no convergence after {most_rounds} rounds")


def equivalence(mean: float, se: float, margin: float) -> dict:
    """Two one-sided tests of a mean within the margin, with the normal distribution."""
    if se <= 0:
        return {"p": None, "lower": mean, "upper": mean}
    z = NormalDist()
    p = max(1 - z.cdf((mean + margin) / se), z.cdf((mean - margin) / se))
    half = z.inv_cdf(0.95) * se
    return {"p": p, "lower": mean - half, "upper": mean + half}


def smallest_margin(se: float, ladder: list[float], divisor: float = 2.925) -> float | None:
    """The first margin of an ascending ladder that the standard error has power for; None without one."""
    return next((m for m in sorted(ladder) if se <= m / divisor), None)


def binomial_tail(n: int, p: float, least: int) -> float:
    """Probability of at least ``least`` successes of n."""
    return math.fsum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(max(least, 0), n + 1))


def _gamma_share(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function by its series, or by the continued fraction of the rest."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        step = i * (a - i)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def chi_square_quantile(p: float, degrees: float) -> float:
    """Quantile of the chi-square distribution by bisection."""
    lo, hi = 0.0, degrees + 10.0
    while _gamma_share(degrees / 2, hi / 2) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _gamma_share(degrees / 2, mid / 2) < p else (lo, mid)
    return (lo + hi) / 2


def deviation_interval(sd: float, n: int, level: float = 0.95) -> tuple[float, float] | None:
    """Interval of a standard deviation from n normal values; None for fewer than two."""
    if n < 2:
        return None
    tail = (1 - level) / 2
    return tuple(sd * math.sqrt((n - 1) / chi_square_quantile(p, n - 1)) for p in (1 - tail, tail))


def smallest_effect(sd: float, n: int, tests: int = 1, rho: float = 0.0, alpha: float = 0.05, power: float = 0.8) -> float | None:
    """Mean that n values can tell from 0, two-sided, with ``alpha`` shared by the tests; values with autocorrelation ``rho`` count for fewer."""
    if n < 1:
        return None
    z = NormalDist()
    effective = n * (1 - rho) / (1 + rho)
    return (z.inv_cdf(1 - alpha / tests / 2) + z.inv_cdf(power)) * sd / math.sqrt(effective)


def correlation_difference(ranked: DataFrame, row: str, a: str, b: str, outcome: str, draws: int = 500, seed: int = 0) -> dict:
    """Difference of the correlations of ``a`` and ``b`` with the outcome, and its deviation under a bootstrap of rows.

    Predictions stay as they are; rows are weighted by Poisson numbers drawn
    from a hash of their id, so a lost task comes out the same. Meant for
    midranks. One row of sums per draw leaves each task; those are added up by
    the JVM. Rows with a null don't count; None without variance.
    """
    whole = ranked.where(" and ".join(f"`{c}` is not null" for c in (row, a, b, outcome)))
    data = whole.select(F.col(row).cast("string").alias("i"), *(F.col(c).cast("double").alias(n) for c, n in ((a, "a"), (b, "b"), (outcome, "y"))))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((9, draws + 1))
        for batch in batches:
            x = batch[["a", "b", "y"]].to_numpy()
            ones, u, v, y = np.ones(len(x)), x[:, 0], x[:, 1], x[:, 2]
            w = np.stack([np.r_[1, np.random.default_rng(xxhash.xxh64_intdigest(f"{seed}|{i}")).poisson(1.0, draws)] for i in batch["i"]]) if len(x) else np.zeros((0, draws + 1))
            total += np.stack([ones, u, v, y, u * u, v * v, y * y, u * y, v * y]) @ w
        yield pd.DataFrame({"s": [total.ravel().tolist()]})

    per = data.mapInPandas(sums, "s array<double>").select(F.posexplode("s").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s"))
    got = {r["k"]: r["s"] for r in per.collect()}  # nine sums for each draw
    n, u, v, y, uu, vv, yy, uy, vy = np.array([got.get(k, 0.0) for k in range(9 * (draws + 1))]).reshape(9, -1)

    def corr(p, pp, py):
        spread = (n * pp - p * p) * (n * yy - y * y)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(spread > 1e-9, (n * py - p * y) / np.sqrt(np.maximum(spread, 1e-300)), np.nan)

    d = corr(u, uu, uy) - corr(v, vv, vy)
    if np.isnan(d[0]):
        return {"difference": None, "sd": None, "n": int(n[0])}
    rest = d[1:][~np.isnan(d[1:])]
    return {"difference": float(d[0]), "sd": float(rest.std(ddof=1)) if len(rest) > 1 else None, "n": int(n[0])}
