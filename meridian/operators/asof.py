"""Bitemporal lookups: what was known at a time, what came before, what comes next.

Every lookup runs as a running maximum over facts and questions ordered in
time. Both are first reduced to one row per key and day, so that no window over
a key can outgrow the calendar, however many rows the key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_known(
    questions: DataFrame,
    facts: DataFrame,
    *,
    keys: list[str],
    at: str,
    available: Column,
    order: list[Column],
    inclusive: bool = True,
) -> DataFrame:
    """``(keys, at, known)``: for each distinct question the greatest ``struct(order)`` of the facts available by then.

    ``order`` decides from left to right and should end in a total tie-break.
    ``inclusive`` takes facts that became available on the day itself. Facts
    with a null key or availability are never known; without any known fact
    ``known`` is null.
    """
    q = questions.select(*keys, F.col(at).cast("date").alias("_t")).distinct()
    best = facts.select(*keys, available.cast("date").alias("_t"), F.struct(*order).alias("known"))
    best = best.where(F.col("_t").isNotNull()).groupBy(*keys, "_t").agg(F.max("known").alias("known"))
    rank = F.lit(1 if inclusive else 0)
    kind = best.schema["known"].dataType
    union = best.select(*keys, "_t", "known", (F.lit(1) - rank).alias("_k"), F.lit(False).alias("_q")).unionByName(
        q.select(*keys, "_t", F.lit(None).cast(kind).alias("known"), rank.alias("_k"), F.lit(True).alias("_q"))
    )
    w = Window.partitionBy(*keys).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    return union.withColumn("known", F.max("known").over(w)).where("_q").select(*keys, F.col("_t").alias(at), "known")


def next_after(questions: DataFrame, events: DataFrame, *, keys: list[str], at: str, when: str, inclusive: bool = False) -> DataFrame:
    """``(keys, at, next)``: the first event day after each question's day (or on it, if ``inclusive``)."""
    q = questions.select(*keys, F.col(at).cast("date").alias("_t"), F.lit(None).cast("date").alias("_e"), F.lit(True).alias("_q")).distinct()
    e = events.select(*keys, F.col(when).cast("date").alias("_t"), F.col(when).cast("date").alias("_e"), F.lit(False).alias("_q")).distinct()
    union = q.unionByName(e.where("_t is not null"))
    side = F.col("_q").cast("int") if inclusive else -F.col("_q").cast("int")
    w = Window.partitionBy(*keys).orderBy(F.col("_t").desc(), side).rowsBetween(Window.unboundedPreceding, 0)
    return union.withColumn("next", F.min("_e").over(w)).where("_q").select(*keys, F.col("_t").alias(at), "next")


def duration_bucket(start: Column, end: Column) -> Column:
    """``instant``, ``Q``, ``H1``, ``9M``, ``FY`` or ``other``, by the days of a period; 0 days and fewer are ``other``."""
    days = F.datediff(end, start)
    return (
        F.when(start.isNull() | end.isNull(), "instant")
        .when(days <= 0, "other")
        .when(days <= 115, "Q")
        .when(days <= 210, "H1")
        .when(days <= 300, "9M")
        .when(days <= 400, "FY")
        .otherwise("other")
    )


def duration_preference(bucket: Column) -> Column:
    """Full years first, then the shortest."""
    names = ["FY", "Q", "H1", "9M", "other"]
    return F.coalesce(*(F.when(bucket == b, F.lit(len(names) - i)) for i, b in enumerate(names)), F.lit(0))


def partner_near(
    rows: DataFrame,
    *,
    keys: list[str],
    day: str,
    tie: str,
    least: int,
    most: int,
    ideal: int,
) -> DataFrame:
    """``(keys, day, tie, partner, gap)``: the earlier row of the same keys ``least`` to ``most`` days before, nearest to ``ideal``, then with the smallest ``tie``.

    One row per (keys, day) stands in for the partners of a day (the smallest
    ``tie``), and partners are met over blocks of the look-back's width, so a
    busy key is spread over its blocks.
    """
    width = most - least + 1
    number = F.datediff(day, F.lit("1970-01-01").cast("date"))
    firsts = rows.where(F.col(day).isNotNull()).groupBy(*keys, day).agg(F.min(tie).alias("partner"))
    right = firsts.select(*keys, F.col(day).alias("_d"), "partner", F.floor(number / width).alias("_b"))
    left = rows.where(F.col(day).isNotNull()).select(*keys, day, tie).distinct()
    left = left.withColumn("_b", F.explode(F.sequence(F.floor((number - most) / width), F.floor((number - least) / width))))
    gap = F.datediff(day, "_d")
    met = left.join(right, [*keys, "_b"]).where(gap.between(least, most))
    best = F.min(F.struct(F.abs(gap - ideal).alias("off"), "partner", gap.alias("gap")))
    return met.groupBy(*keys, day, tie).agg(best.alias("_p")).select(*keys, day, tie, F.col("_p.partner").alias("partner"), F.col("_p.gap").alias("gap"))
