"""Continuous periods and gaps of dated spells, by a sweep over boundary events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def boundary_events(df: DataFrame, key: Column, start: Column, end: Column) -> DataFrame:
    """Net change of the number of active spells per key and day: ``(_k, _d, _delta)``.

    A spell that has no start, or that ends on or before its start, has no
    events. An open spell has no closing event. Days on which openings and
    closings cancel out are removed, so spells that touch are continuous.

    The sum per (key, day) is combined before the shuffle. Afterwards a key has
    at most one row for each calendar day, however many spells it has: no
    window over a key can grow with the data, which is what makes a key with a
    third of all rows harmless.
    """
    spells = df.select(key.alias("_k"), start.cast("date").alias("_s"), end.cast("date").alias("_e"))
    spells = spells.where(F.col("_s").isNotNull() & (F.col("_e").isNull() | (F.col("_e") > F.col("_s"))))
    events = spells.select(
        "_k",
        F.inline(
            F.filter(
                F.array(
                    F.struct(F.col("_s").alias("_d"), F.lit(1).cast("long").alias("_delta")),
                    F.struct(F.col("_e").alias("_d"), F.lit(-1).cast("long").alias("_delta")),
                ),
                lambda x: x["_d"].isNotNull(),
            )
        ),
    )
    return events.groupBy("_k", "_d").agg(F.sum("_delta").alias("_delta")).where("_delta <> 0")


def periods_and_gaps(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """``(key, kind, start_date, end_date)`` with kind ``period`` or ``gap``; end exclusive.

    Sweep line: the running sum of the events is the number of spells active
    from that day on. A period starts where it leaves zero and ends where it
    returns to zero; the stretch from such an end to the next start is a gap.
    ``end_date`` is null for a period that is still open. Repeated rows change
    nothing. A null key is a group of its own; an empty table gives no rows;
    other columns of ``df`` are ignored, whatever their names.
    """
    events = boundary_events(df, F.col(key), F.col(start), F.col(end))
    sweep = Window.partitionBy("_k").orderBy("_d")
    swept = events.withColumn("_active", F.sum("_delta").over(sweep.rowsBetween(Window.unboundedPreceding, 0)))
    edges = swept.where((F.col("_active") == 0) | (F.col("_active") == F.col("_delta")))
    paired = edges.withColumn("_next", F.lead("_d").over(sweep))
    opened = F.col("_active") > 0
    return paired.where(opened | F.col("_next").isNotNull()).select(
        F.col("_k").alias(key),
        F.when(opened, "period").otherwise("gap").alias("kind"),
        F.col("_d").alias("start_date"),
        F.col("_next").alias("end_date"),
    )


def coverage_summary(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Per key: number of periods and gaps, days covered by closed periods, days in gaps, still open."""
    pg = periods_and_gaps(df, key, start, end)
    days = F.datediff("end_date", "start_date")
    period = F.col("kind") == "period"
    return pg.groupBy(key).agg(
        F.count_if(period).alias("n_periods"),
        F.count_if(~period).alias("n_gaps"),
        F.coalesce(F.sum(F.when(period, days)), F.lit(0)).alias("days_covered"),
        F.coalesce(F.sum(F.when(~period, days)), F.lit(0)).alias("days_in_gaps"),
        F.bool_or(period & F.col("end_date").isNull()).alias("is_open"),
    )
