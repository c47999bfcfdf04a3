"""State of a family of alias concepts per entity, from the quarters that each covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.session import broadcast_if_small


def classify(
    rows: DataFrame, families: DataFrame, *, entity: str, concept: str, quarter: str, bar: float = 0.75, stale_after: int = 2, most_overlap: int = 1
) -> DataFrame:
    """``(entity, family, state, winner, coverage, switch_quarters)`` for each pair of an entity and a family.

    The target are the quarters from the entity's first to its last. A concept
    is at the bar if it covers ``bar`` of them, and alive if it ends within
    ``stale_after`` quarters of the entity's last.

    ``SINGLE`` or ``DOMINANT``: a concept at the bar is alive, and is the only
    one at the bar or one of several; the winner is the first alive by
    preference. Else, with two or more concepts that cover ``bar`` together: if
    the last one to end is stale, ``PARTIAL``; if at most ``most_overlap``
    quarters are covered more than once or just one is alive, ``MIGRATION``,
    with, for each concept in the order of their ends, its first quarter after
    the one before ended; else ``OVERLAP``. Without any row ``ABSENT``, otherwise ``PARTIAL``.

    A pair's sets of quarters are bounded by the calendar and the family's
    concepts; rows are made distinct before anything is gathered.
    """
    q = rows.where(F.col(quarter).isNotNull()).select(F.col(entity).alias("e"), F.col(concept).alias("c"), F.col(quarter).alias("q")).distinct()
    fam = families.select("family", F.col(concept).alias("c"), "preference").distinct()
    spans = q.groupBy("e").agg(F.min("q").alias("lo"), F.max("q").alias("hi")).withColumn("target", F.col("hi") - F.col("lo") + 1)
    tags = q.join(broadcast_if_small(fam), "c").groupBy("e", "family", "c").agg(F.min("preference").alias("p"), F.array_sort(F.collect_set("q")).alias("qs"))
    tags = tags.join(spans, "e")
    share = F.size("qs") / F.col("target")
    last = F.array_max("qs")
    tags = tags.select(
        "e", "family", "hi", "target",
        F.struct(F.col("p"), F.col("c"), F.col("qs"), last.alias("last"), (share >= bar).alias("at_bar"), (last >= F.col("hi") - stale_after).alias("alive"), share.alias("share")).alias("t"),
    )
    g = tags.groupBy("e", "family").agg(F.max("hi").alias("hi"), F.max("target").alias("target"), F.array_sort(F.collect_list("t")).alias("ts"))
    live = F.filter("ts", lambda t: t["at_bar"] & t["alive"])
    at_bar = F.filter("ts", lambda t: t["at_bar"])
    union = F.array_distinct(F.flatten(F.transform("ts", lambda t: t["qs"])))
    by_last = F.array_sort(F.transform("ts", lambda t: F.struct(t["last"].alias("last"), t["c"].alias("c"), t["qs"].alias("qs"), t["alive"].alias("alive"))))
    g = g.select("e", "family", "hi", "target", "ts", live.alias("live"), at_bar.alias("bars"), union.alias("u"), by_last.alias("o"))
    n = F.size("o")
    newer = F.try_element_at("o", F.lit(-1))
    overlap = F.aggregate("o", F.lit(0), lambda s, t: s + F.size(t["qs"])) - F.size("u")
    alive = F.size(F.filter("o", lambda t: t["alive"]))
    together = (n >= 2) & (F.size("u") / F.col("target") >= bar)
    migrated = together & newer["alive"] & ((overlap <= most_overlap) | (alive == 1))
    state = (
        F.when((F.size("live") > 0) & (F.size("bars") == 1), "SINGLE")
        .when(F.size("live") > 0, "DOMINANT")
        .when(together & ~newer["alive"], "PARTIAL")
        .when(migrated, "MIGRATION")
        .when(together, "OVERLAP")
        .otherwise("PARTIAL")
    )
    pairs = F.arrays_zip(F.slice("o", 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice("o", 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    switch = F.transform(pairs, lambda x: F.array_min(F.filter(x["b"]["qs"], lambda q: q > x["a"]["last"])))
    found = g.select(
        "e", "family", state.alias("state"), F.when(F.size("live") > 0, F.col("live")[0]["c"]).alias("winner"),
        F.round(F.size("u") / F.col("target"), 6).alias("coverage"), F.when((F.size("live") == 0) & migrated, switch).alias("switch_quarters"),
    )
    every = spans.select("e", F.explode(F.array(*(F.lit(r["family"]) for r in fam.select("family").distinct().orderBy("family").collect()))).alias("family"))
    out = every.join(found, ["e", "family"], "left")
    return out.select(F.col("e").alias(entity), "family", F.coalesce("state", F.lit("ABSENT")).alias("state"), "winner", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), "switch_quarters")
