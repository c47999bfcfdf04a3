"""Positions and ranks in a total order, without gathering a group in one task.

Rows are range-partitioned by group and value. Counts are summed up within
partitions, and only the sizes of the partitions reach the driver: a group with
a third of all rows is spread over a third of the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.session import checkpointed

FEW_GROUPS = 100_000


def _with_running(rows: DataFrame, order: list[Column], weight: Column, name: str) -> DataFrame:
    """``rows`` with the sum of the weights of all rows before each in the order.

    The ranges are written to the checkpoint folder, as a repeated range
    sampling might cut differently.
    """
    ranged = checkpointed(rows.withColumn("__weight", weight.cast("long")).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg(F.sum("__weight").alias("n")).collect()}
    start, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, start))
        start += sizes[p]
    table = F.broadcast(rows.sparkSession.createDataFrame(offsets, "__part int, __offset long"))
    before = F.sum("__weight").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__weight")
    return ranged.withColumn("__before", before).join(table, "__part").withColumn(name, F.col("__offset") + F.col("__before")).drop("__part", "__weight", "__offset", "__before")


def row_index(rows: DataFrame, order: list[Column], name: str = "index") -> DataFrame:
    """``rows`` numbered from 0 in a total order."""
    return _with_running(rows, order, F.lit(1), name)


def _with_starts(indexed: DataFrame, group: list[str], index: str, size: Column) -> DataFrame:
    """``indexed`` with ``__start`` (least index of the group) and ``__size`` (its size). Few groups are broadcast."""
    starts = indexed.groupBy(*group).agg(F.min(index).alias("__start"), F.sum(size).alias("__size"))
    renamed = checkpointed(starts.select(*(F.col(g).alias(f"__group{i}") for i, g in enumerate(group)), "__start", "__size"))
    on = F.lit(True)
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__group{i}"))
    small = F.broadcast(renamed) if renamed.count() <= FEW_GROUPS else renamed
    return indexed.join(small, on).drop(*(f"__group{i}" for i in range(len(group))))


def position_in_group(rows: DataFrame, group: list[str], order: list[Column], name: str = "position", size: str = "group_size") -> DataFrame:
    """``rows`` with their position from 0 within their group, and the group's size. ``order`` must be total within a group."""
    indexed = row_index(rows, [*(F.col(g) for g in group), *order], "__index")
    return _with_starts(indexed, group, "__index", F.lit(1)).withColumn(name, F.col("__index") - F.col("__start")).withColumnRenamed("__size", size).drop("__index", "__start")


def value_ranks(rows: DataFrame, group: list[str], value: str, *sums: Column, weight: Column | None = None) -> DataFrame:
    """``(group, value, lowest, ties, group_size, ...)``: per distinct value of a group the rank of its first row from 1, and how many share it.

    Nulls are not ranked. ``sums`` are aggregated per value beside the counts. A
    row counts as ``weight`` rows, if given.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg((F.count("*") if weight is None else F.sum(weight)).alias("ties"), *sums)
    running = _with_running(counts, [*(F.col(g) for g in group), F.col(value)], F.col("ties"), "__index")
    ranked = _with_starts(running, group, "__index", F.col("ties"))
    return ranked.withColumn("lowest", F.col("__index") - F.col("__start") + 1).withColumnRenamed("__size", "group_size").drop("__index", "__start")


def midrank() -> Column:
    """Average rank of the ties of a row of ``value_ranks``."""
    return F.col("lowest") + (F.col("ties") - 1) / 2
