"""Clusters, islands, rolling measures and ranks over ordered rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridian.operators.order import midrank, value_ranks
from meridian.session import checkpointed


def gap_clusters(rows: DataFrame, key: str, day: str, gap_days: int) -> DataFrame:
    """``(key, day, cluster)``: a gap of more than ``gap_days`` to the previous day of the key starts a new cluster.

    Works on distinct days, of which a key has no more than the calendar.
    """
    days = rows.where(F.col(day).isNotNull()).select(key, day).distinct()
    w = Window.partitionBy(key).orderBy(day)
    start = F.coalesce((F.datediff(day, F.lag(day).over(w)) > gap_days).cast("int"), F.lit(0))
    return days.withColumn("_s", start).withColumn("cluster", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def last_of_cluster(rows: DataFrame, key: str, day: str, gap_days: int, order: list[Column]) -> DataFrame:
    """The row of each gap cluster with the greatest ``struct(order)``, as ``(key, cluster, n, last)``."""
    clusters = gap_clusters(rows, key, day, gap_days)
    joined = rows.join(clusters, [key, day])
    return joined.groupBy(key, "cluster").agg(F.count("*").alias("n"), F.max(F.struct(*order)).alias("last"))


def islands(panel: DataFrame, key: str, position: str) -> DataFrame:
    """``(key, first, last, n)``: maximal runs of consecutive dense positions at which the key is present."""
    present = panel.select(key, position).distinct()
    w = Window.partitionBy(key).orderBy(position)
    run = present.withColumn("_g", F.col(position) - F.row_number().over(w))
    return run.groupBy(key, "_g").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n")).drop("_g")


def dense_index(values: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values with their position from 0. Meant for calendars: the values are gathered in one task."""
    return values.select(column).where(F.col(column).isNotNull()).distinct().withColumn(name, F.row_number().over(Window.orderBy(column)) - 1)


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group. Spark limits each group before the shuffle, so a large group sends n rows a task."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; null with fewer than 3 pairs or without variance on a side."""
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    fine = (F.count(xs) >= 3) & (F.stddev_pop(xs) > 0) & (F.stddev_pop(ys) > 0)
    sd = F.stddev_pop(xs) * F.stddev_pop(ys)
    return F.when(fine, F.try_divide(F.covar_pop(xs, ys), sd))


def rank_correlation(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """``(group, n, ic)``: Spearman's correlation with midranks; pairs with a null are left out before ranking."""
    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(group, x, y)
    cells = checkpointed(pairs.groupBy(group, x, y).agg(F.count("*").alias("_k")))
    for column, name in ((x, "_x"), (y, "_y")):
        ranks = value_ranks(cells, [group], column, weight=F.col("_k"))
        cells = cells.join(ranks.select(F.col(group).alias("_g"), F.col(column).alias("_v"), midrank().alias(name)), F.col(group).eqNullSafe(F.col("_g")) & (F.col(column) == F.col("_v"))).drop("_g", "_v")
    k, a, b = F.col("_k"), F.col("_x"), F.col("_y")
    s = cells.groupBy(group).agg(F.sum(k).alias("n"), F.sum(k * a).alias("a"), F.sum(k * b).alias("b"), F.sum(k * a * a).alias("aa"), F.sum(k * b * b).alias("bb"), F.sum(k * a * b).alias("ab"))
    n = F.col("n")
    va, vb = n * F.col("aa") - F.col("a") * F.col("a"), n * F.col("bb") - F.col("b") * F.col("b")
    fine = (n >= 3) & (va > 1e-9) & (vb > 1e-9)
    return s.select(group, "n", F.when(fine, (n * F.col("ab") - F.col("a") * F.col("b")) / (F.sqrt(va) * F.sqrt(vb))).alias("ic"))


def exact_quantiles(rows: DataFrame, column: str, probabilities: list[float]) -> list[float | None]:
    """Exact linear-interpolated quantiles of a double column of any size.

    The interval that holds an order statistic is cut into 4,096 bins, counted,
    and narrowed down to one of them, again and again, for all places in one
    pass. The column is written to the checkpoint folder once; only the counts
    of the bins reach the driver.
    """
    x = F.col(column).cast("double")
    values = checkpointed(rows.where(x.isNotNull() & ~F.isnan(x)).select(x.alias("_v")))
    n, lo, hi = values.agg(F.count("*"), F.min("_v"), F.max("_v")).first()
    if n == 0:
        return [None for _ in probabilities]
    places = [(int(np.floor(p * (n - 1))), int(np.ceil(p * (n - 1))), p * (n - 1)) for p in probabilities]
    stats = _order_statistics(values, sorted({k for a, b, _ in places for k in (a, b)}), lo, hi)
    return [stats[a] + (stats[b] - stats[a]) * (at - a) for a, b, at in places]


_BINS = 4096


def _order_statistics(values: DataFrame, wanted: list[int], lo: float, hi: float) -> dict[int, float]:
    """Values at the given places. Intervals that still hold several values never overlap, so a row falls into one of them at most."""
    open_ = {k: (lo, hi, 0) for k in wanted}  # the interval of each place, and how many values lie below it
    out: dict[int, float] = {}
    while True:
        done = [k for k, (a, b, _) in open_.items() if (b - a) / _BINS <= 0]
        out |= {k: open_.pop(k)[0] for k in done}
        if not open_:
            return out
        intervals = sorted({(a, b) for a, b, _ in open_.values()})
        inside = [(F.col("_v") >= a) & (F.col("_v") <= b) for a, b in intervals]
        of = F.coalesce(*(F.when(x, i) for i, x in enumerate(inside)))
        bin_ = F.coalesce(*(F.when(x, F.least(F.floor((F.col("_v") - a) / ((b - a) / _BINS)), F.lit(_BINS - 1))) for x, (a, b) in zip(inside, intervals)))
        counted = values.groupBy(of.alias("i"), bin_.alias("b")).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).where("i is not null").collect()
        by: dict[int, list] = {}
        for r in sorted(counted, key=lambda r: r["lo"]):
            by.setdefault(r["i"], []).append(r)
        for k, (a, b, below) in open_.items():
            for r in by[intervals.index((a, b))]:
                if k < below + r["n"]:
                    open_[k] = (r["lo"], r["hi"], below)
                    break
                below += r["n"]


def trailing_percentile(
    rows: DataFrame, *, entity: str, day: str, tie: str, value: str, window_days: int = 180, least: int = 2, same_day: bool = True, range_rows: int = 500_000
) -> DataFrame:
    """``(entity, day, tie, pct)``: midrank percentile of each row's value among all entities' latest values of the trailing window.

    The window is ``[day - window_days, day]``, or without the day itself if
    not ``same_day``. Each entity is represented by its latest row (by day,
    then ``tie``); with ``same_day`` the row itself stands for its own entity.
    Fewer than ``least`` values, or a null value, give null.

    A row represents its entity until the next one, or until the window has
    passed: an interval of days. Intervals are cut at blocks of
    ``window_days / 6`` days, and blocks into ranges of values of about
    ``range_rows`` rows of all, at most 256. Rows of a block and range with the
    same value and days are counted before they meet; a block and range is
    solved alone with sorted arrays, and the lower ranges add their numbers of
    active rows per day. So rows are copied at most eight times, nothing is
    paired, and neither a day nor a value gathers all entities in one task.
    """
    width = max(window_days // 6, 1)
    epoch = F.lit("1970-01-01").cast("date")
    number = F.col(value).cast("double")
    base = rows.where(F.col(day).isNotNull() & F.col(entity).isNotNull()).select(
        F.col(entity).cast("string").alias("_e"), F.datediff(day, epoch).alias("_d"), F.col(tie).cast("string").alias("_t"), F.when(~F.isnan(number), number).alias("_v")
    )
    n, bounds = 0, []
    if first := base.agg(F.count("_v")).first()[0]:
        n = min(-(-first // range_rows), 256)
    if n > 1:
        bounds = sorted(set(base.agg(F.percentile_approx("_v", [k / n for k in range(1, n)])).first()[0]))
    range_of = F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b <= F.col("_v"))) if bounds else F.lit(0)

    latest = base.groupBy("_e", "_d").agg(F.max(F.struct("_t", "_v")).alias("_r")).select("_e", "_d", F.col("_r._v").alias("_v"))
    w = Window.partitionBy("_e").orderBy("_d")
    until = F.least(F.coalesce(F.lead("_d").over(w), F.lit(2**30)) - (1 if same_day else 0), F.col("_d") + window_days)
    # representative on days [from, to]
    spans = latest.select((F.col("_d") + (0 if same_day else 1)).alias("_from"), until.alias("_to"), "_v").where("_to >= _from and _v is not null")
    block = lambda c: F.floor(F.col(c) / width)
    cut = spans.select(F.explode(F.sequence(block("_from"), block("_to"))).alias("_b"), "_from", "_to", "_v", range_of.alias("_g"))
    begin, end = F.col("_b") * width, F.col("_b") * width + width - 1
    parts = cut.groupBy("_b", "_g", "_v", F.greatest("_from", begin).cast("int").alias("_from"), F.least("_to", end).cast("int").alias("_to")).agg(F.count("*").alias("_w"))
    parts = checkpointed(parts)
    asks = base.where("_v is not null").select(block("_d").alias("_b"), range_of.alias("_g"), "_v", F.col("_d").alias("_from")).distinct()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = pdf[pdf["_w"] == 0]
        reps = pdf[pdf["_w"] > 0].sort_values("_v")
        v, weight, start, stop = (reps[c].to_numpy() for c in ("_v", "_w", "_from", "_to"))
        out = [pd.DataFrame({"_d": [], "_v": [], "_below": [], "_equal": []})]
        for d, q in asked.groupby("_from"):
            x = q["_v"].to_numpy()
            upto = np.concatenate([[0], np.cumsum(np.where((start <= d) & (stop >= d), weight, 0))])
            below = upto[np.searchsorted(v, x, "left")]
            out.append(pd.DataFrame({"_d": d, "_v": x, "_below": below, "_equal": upto[np.searchsorted(v, x, "right")] - below}))
        return pd.concat(out).astype({"_d": "int32", "_v": "float64", "_below": "int64", "_equal": "int64"})

    both = parts.unionByName(asks.withColumns({"_to": F.col("_from"), "_w": F.lit(0).cast("long")}))
    solved = both.groupBy("_b", "_g").applyInPandas(solve, "_d int, _v double, _below long, _equal long")
    # active rows of each range on each day that is asked for: changes added up within the block
    days = asks.select("_b", F.col("_from").alias("_d")).distinct()
    grid = days.select("_b", F.explode(F.sequence(F.lit(0), F.lit(len(bounds)))).alias("_g"), "_d", F.lit(0).cast("long").alias("_n"), F.lit(1).alias("_ask"))
    changes = parts.select("_b", "_g", F.explode(F.array(F.struct(F.col("_from").alias("_d"), F.col("_w").alias("_n")), F.struct((F.col("_to") + 1).alias("_d"), (-F.col("_w")).alias("_n")))).alias("_c"))
    per = changes.select("_b", "_g", "_c._d", "_c._n", F.lit(0).alias("_ask")).unionByName(grid).groupBy("_b", "_g", "_d").agg(F.sum("_n").alias("_n"), F.max("_ask").alias("_ask"))
    active = per.withColumn("_n", F.sum("_n").over(Window.partitionBy("_b", "_g").orderBy("_d"))).where("_ask = 1")
    by_day = Window.partitionBy("_b", "_d")
    lower = F.sum("_n").over(by_day.orderBy("_g")) - F.col("_n")
    active = active.select("_d", F.col("_g"), lower.alias("_lower"), F.sum("_n").over(by_day).alias("_all"))

    asked = base.join(latest.withColumnRenamed("_v", "_mine"), ["_e", "_d"]).withColumn("_g", range_of)
    found = asked.join(solved, ["_d", "_v"], "left").join(active, ["_d", "_g"], "left")
    below, equal, total = (F.coalesce(c, F.lit(0)) for c in (F.col("_lower") + F.col("_below"), F.col("_equal"), F.col("_all")))
    if same_day:  # the row itself stands for its entity
        one = lambda c: F.coalesce(c.cast("int"), F.lit(0))
        mine, x = F.col("_mine"), F.col("_v")
        below, equal, total = below - one(mine < x), equal - one(mine == x) + 1, total - one(mine.isNotNull()) + 1
    pct = F.when(F.col("_v").isNotNull() & (total >= least), (below + 0.5 * equal) / total)
    return found.select(F.col("_e").alias(entity), F.date_add(epoch, F.col("_d")).alias(day), F.col("_t").alias(tie), pct.alias("pct"))


def neighbour_outliers(facts: DataFrame, *, entity: str, at: str, value: str, ratio: float = 50.0, large: float = 5e10, large_ratio: float = 10.0) -> DataFrame:
    """``(entity, at, value, reason)`` for values that are implausible or jump above their neighbours in time.

    Reasons: ``non_positive``, ``too_small`` (< 1e6), ``too_large`` (> 1e13) and
    ``jump``. Repeatedly, values of ``ratio`` times the smaller median of the
    two adjacent days (or ``large_ratio`` times, if at least ``large``) are
    flagged together, until nothing is left to flag. Repeated rows count once;
    an entity's values of one day come down to at most the distinct ones.
    """
    rows = facts.where(F.col(value).isNotNull() & F.col(at).isNotNull()).select(entity, at, F.col(value).cast("double").alias("value")).distinct()
    schema = T.StructType([rows.schema[entity], rows.schema[at], T.StructField("value", T.DoubleType()), T.StructField("reason", T.StringType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf["value"]
        reason = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
        reason[v <= 0] = "non_positive"
        reason[(v > 0) & (v < 1e6)] = "too_small"
        reason[v > 1e13] = "too_large"
        while True:
            active = pdf[reason.isna()]
            medians = active.groupby(at)["value"].median().sort_index()
            if len(medians) < 2:
                break
            near = pd.concat([medians.shift(1), medians.shift(-1)], axis=1).min(axis=1)
            r = active["value"] / active[at].map(near)
            bad = (r >= ratio) | ((active["value"] >= large) & (r >= large_ratio))
            if not bad.any():
                break
            reason[bad[bad].index] = "jump"
        return pdf.assign(reason=reason)[reason.notna()]

    return rows.groupBy(entity).applyInPandas(run, schema)

