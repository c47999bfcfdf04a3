"""Rates with intervals, agreement, ranking quality and variance components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.operators.order import midrank, value_ranks

Z = 1.959964


def wilson(successes: Column, trials: Column, z: float = Z) -> tuple[Column, Column]:
    """Wilson's score interval; nulls without trials."""
    n, p = trials.cast("double"), F.try_divide(successes.cast("double"), trials)
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    some = trials > 0
    return F.when(some, centre - half), F.when(some, centre + half)


def rate_by(rows: DataFrame, group: list[str], hit: Column) -> DataFrame:
    """``(group, n, hits, rate, lower, upper)``; rows with a null hit are not counted."""
    counted = rows.groupBy(*group).agg(F.count(hit).alias("n"), F.count_if(hit).alias("hits"))
    lo, hi = wilson(F.col("hits"), F.nullif(F.col("n"), F.lit(0)))
    return counted.select(*group, "n", "hits", F.try_divide(F.col("hits"), F.col("n")).alias("rate"), lo.alias("lower"), hi.alias("upper"))


def class_scores(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """``(label, support, tp, fp, fn, precision, recall, f1)`` of each label on either side; empty denominators give 0."""
    cells = rows.where(F.col(gold).isNotNull() & F.col(predicted).isNotNull()).groupBy(gold, predicted).count()
    sides = cells.select(F.inline(F.array(
        F.struct(F.col(gold).cast("string").alias("label"), F.col("count").alias("g"), F.lit(0).cast("long").alias("p"), F.when(F.col(gold) == F.col(predicted), F.col("count")).otherwise(0).alias("t")),
        F.struct(F.col(predicted).cast("string").alias("label"), F.lit(0).cast("long").alias("g"), F.col("count").alias("p"), F.lit(0).cast("long").alias("t")),
    )))
    s = sides.groupBy("label").agg(F.sum("g").alias("support"), F.sum("p").alias("_p"), F.sum("t").alias("tp"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision, recall = share(F.col("tp"), F.col("_p")), share(F.col("tp"), F.col("support"))
    return s.select(
        "label", "support", "tp", (F.col("_p") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"),
        precision.alias("precision"), recall.alias("recall"), share(2 * precision * recall, precision + recall).alias("f1"),
    )


def auc_by(rows: DataFrame, group: str, positive: str, score: str) -> DataFrame:
    """``(group, n_pos, n_neg, auc)``: Mann-Whitney area with midranks; null with one class only."""
    pairs = rows.where(F.col(positive).isNotNull() & F.col(score).isNotNull())
    y = F.col(positive).cast("boolean")
    ranked = value_ranks(pairs.select(group, y.alias("_y"), F.col(score).alias("_v")), [group], "_v", F.count_if("_y").alias("_p"))
    s = ranked.groupBy(group).agg(F.sum("_p").alias("n_pos"), F.sum(F.col("ties") - F.col("_p")).alias("n_neg"), F.sum(F.col("_p") * midrank()).alias("_s"))
    p, n = F.col("n_pos"), F.col("n_neg")
    return s.select(group, "n_pos", "n_neg", F.try_divide(F.col("_s") - p * (p + 1) / 2, p * n).alias("auc"))


def intraclass(rows: DataFrame, group: str, value: str) -> DataFrame:
    """``(n_groups, n, icc)``: one-way intraclass correlation with unequal group sizes, from sums per group."""
    x = F.col(value).cast("double")
    per = rows.where(F.col(group).isNotNull() & x.isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    t = per.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum(F.col("n") * F.col("n")).alias("nn"),
    )
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)
    within = (F.col("q") - F.col("b")) / (F.col("n") - F.col("k"))
    size = (F.col("n") - F.col("nn") / F.col("n")) / (F.col("k") - 1)
    fine = (F.col("k") > 1) & (F.col("n") > F.col("k"))
    return t.select(F.col("k").alias("n_groups"), "n", F.when(fine, F.try_divide(between - within, between + (size - 1) * within)).alias("icc"))


def pooled_rate(strata: DataFrame, weight: str, hits: str, n: str, z: float = Z) -> DataFrame:
    """``(rate, n_eff, lower, upper)``: a post-stratified rate with an interval on its effective size; null if a stratum is empty."""
    w, k, m = F.col(weight).cast("double"), F.col(hits).cast("double"), F.col(n).cast("double")
    soft = (k + z * z / 2) / (m + z * z)
    s = strata.agg(
        F.sum(w * F.try_divide(k, m)).alias("rate"), F.sum(w * F.try_divide(soft, F.lit(1.0))).alias("_p"),
        F.sum(w * w * soft * (1 - soft) / F.nullif(m, F.lit(0.0))).alias("_v"), F.min(m).alias("_least"),
    )
    s = s.withColumn("n_eff", F.when(F.col("_least") > 0, F.try_divide(F.col("_p") * (1 - F.col("_p")), F.col("_v"))))
    rate = F.when(F.col("_least") > 0, F.col("rate"))
    e = F.col("n_eff")
    centre, half = (rate + z * z / (2 * e)) / (1 + z * z / e), z * F.sqrt(rate * (1 - rate) / e + z * z / (4 * e * e)) / (1 + z * z / e)
    return s.select(rate.alias("rate"), "n_eff", (centre - half).alias("lower"), (centre + half).alias("upper"))


def paired_measures(rows: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """``(group, n, mean_difference, mean_size, correlation)`` of two measurements of the same things; the correlation is null for fewer than 3 or without variance."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    s = pairs.groupBy(*group).agg(
        F.count("*").alias("n"), F.avg(x - y).alias("mean_difference"), F.avg(F.abs(x - y)).alias("mean_size"),
        F.covar_pop(x, y).alias("_c"), F.stddev_pop(x).alias("_a"), F.stddev_pop(y).alias("_b"),
    )
    fine = (F.col("n") >= 3) & (F.col("_a") > 0) & (F.col("_b") > 0)
    return s.select(*group, "n", "mean_difference", "mean_size", F.when(fine, F.col("_c") / (F.col("_a") * F.col("_b"))).alias("correlation"))


def fold_deltas(scores: DataFrame, fold: str, block: str, score: str, baseline: str) -> DataFrame:
    """``(fold, block, delta)``: each block's score less the baseline's in the same fold; folds without a baseline are left out."""
    base = scores.where(F.col(block) == baseline).select(fold, F.col(score).alias("_base"))
    return scores.where(F.col(block) != baseline).join(base, fold).select(fold, block, (F.col(score) - F.col("_base")).alias("delta"))
