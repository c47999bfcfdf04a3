"""Rows that are exact copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.session import checkpointed

FEW = 1_000_000


def distinct_rows(df: DataFrame, key: str) -> DataFrame:
    """``df`` with rows that are exact copies of each other once, without a shuffle of wide columns.

    Keys that occur more than once are found over the key alone. Only rows with
    such a key, which are few, go through ``distinct``; with more than a million
    such keys all rows do. Rows with equal keys that differ elsewhere are kept.
    """
    many = checkpointed(df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias("_repeated")))
    n = many.count()
    if n == 0:
        return df
    if n > FEW:
        return df.distinct()
    marked = df.join(F.broadcast(many), F.col(key).eqNullSafe(F.col("_repeated")), "left_anti")
    return marked.unionByName(df.join(F.broadcast(many), F.col(key).eqNullSafe(F.col("_repeated")), "left_semi").distinct())
