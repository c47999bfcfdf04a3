"""Connected components, deterministic samples and proportional allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.operators.order import _with_running
from meridian.session import FEW_ROWS, broadcast_if_few, checkpointed


def components(members: DataFrame, node: str, shared: str, most_rounds: int = 50) -> DataFrame:
    """``(node, component)``: nodes that share a value, directly or through others; the component is its smallest node.

    Nodes take the smallest label among the holders of each of their values,
    then the label of their label (pointer jumping), until nothing changes: the
    number of rounds is logarithmic in the length of chains. Only (node, value)
    pairs are exchanged, never pairs of nodes, so a value with very many holders
    costs no more than its holders. Each round is written to the checkpoint folder.
    Chains that need more than ``most_rounds`` are an error, never a wrong answer.
    """
    pairs = checkpointed(members.where(F.col(node).isNotNull()).select(F.col(node).alias("_n"), F.col(shared).alias("_v")).distinct())
    linked = pairs.where(F.col("_v").isNotNull())
    labels = checkpointed(pairs.groupBy("_n").agg(F.min("_n").alias("_l")))
    few = labels.count() <= FEW_ROWS  # there are no more jumps than nodes
    for _ in range(most_rounds):
        least = linked.join(labels, "_n").groupBy("_v").agg(F.min("_l").alias("_m"))
        reached = linked.join(least, "_v").groupBy("_n").agg(F.min("_m").alias("_m"))
        step = labels.join(reached, "_n", "left").select("_n", F.least("_l", F.coalesce("_m", "_l")).alias("_new"), "_l")
        # a label is looked up once, not by each of its nodes; most labels are roots and need no jump
        moved = step.where("_new <> _n").select(F.col("_n").alias("_new"), F.col("_new").alias("_root"))
        jumps = F.broadcast(moved) if few else broadcast_if_few(checkpointed(step.select("_new").distinct().join(moved, "_new")))
        jumped = step.join(jumps, "_new", "left").select("_n", F.least("_new", F.coalesce("_root", "_new")).alias("_new"), "_l")
        jumped = checkpointed(jumped)
        labels = jumped.select("_n", F.col("_new").alias("_l"))
        if jumped.where("_new <> _l").isEmpty():
            return labels.select(F.col("_n").alias(node), F.col("_l").alias("component"))
    raise RuntimeError(f"components still change after {most_rounds} rounds")


def hash_uniform(*parts: Column) -> Column:
    """A uniform number in [0, 1) from the first 8 bytes of sha256 of the parts joined by ``|``."""
    digest = F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
    return F.conv(digest, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def hash_sample(rows: DataFrame, strata: list[str], key: str, n: int, seed: str) -> DataFrame:
    """n rows of each stratum, in the order of ``sha256(seed|key)``: the same rows on every run."""
    w = Window.partitionBy(*strata).orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256), F.col(key))
    return rows.withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= n)


def largest_remainder(counts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``(key, allocated)``: ``total`` seats in proportion to the counts; left-over seats by the largest remainders, ties by key."""
    whole = F.sum(count).over(Window.partitionBy())
    quota = F.col(count) * total / whole
    base = counts.select(key, F.floor(quota).alias("_f"), F.round(quota - F.floor(quota), 12).alias("_r"))
    left = F.lit(total) - F.sum("_f").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.col("_r").desc(), key))
    return base.withColumn("_left", left).withColumn("_place", place).select(key, (F.col("_f") + (F.col("_place") <= F.col("_left")).cast("int")).alias("allocated"))


def stratified_components(members: DataFrame, node: str, component: str, label: str, *, share: float = 0.15, cap: float = 1.5, most_share: float = 0.35, least_train: int = 30, seed: str = "split") -> DataFrame:
    """``(component, split)``: whole components to ``eval`` until each label has its share there, all others to ``train``.

    The rarest label comes first. Of the components that hold it and are not
    taken, the smallest are taken (ties by hash) until ``share`` of the label's
    nodes are in ``eval``, or all of ``eval`` would exceed ``cap`` times its
    share of the nodes: a component with a third of all nodes never fits. Then
    labels of which more than ``most_share`` is in ``eval``, or fewer than
    ``least_train`` nodes in ``train``, get components back, those with most of
    the label first. Repeated rows count once; a null label is none.

    Labels are few and are taken one after the other; components are not
    gathered: running sums over range partitions pick them.
    """
    rows = checkpointed(members.select(F.col(node).alias("_n"), F.col(component).alias("_c"), F.col(label).alias("_l")).distinct())
    size = rows.select("_n", "_c").distinct().groupBy("_c").agg(F.count("*").alias("_size"))
    held = checkpointed(rows.where(F.col("_l").isNotNull()).groupBy("_c", "_l").agg(F.count("*").alias("_k")).join(size, "_c"))
    labels = held.groupBy("_l").agg(F.sum("_k").alias("n")).orderBy("n", "_l").collect()
    room = cap * share * (size.agg(F.sum("_size")).first()[0] or 0)
    spark = members.sparkSession
    taken = spark.createDataFrame([], rows.select("_c").schema)
    tie = F.xxhash64(F.lit(seed), "_c")
    for r in labels:
        mine = held.where(F.col("_l") == r["_l"])
        have = mine.join(taken, "_c", "left_semi").agg(F.sum("_k")).first()[0] or 0
        used = size.join(taken, "_c", "left_semi").agg(F.sum("_size")).first()[0] or 0
        free = mine.join(taken, "_c", "left_anti").where(F.col("_size") <= room - used)
        ordered = [F.col("_size"), tie, F.col("_c")]
        summed = _with_running(_with_running(free, ordered, F.col("_k"), "_before"), ordered, F.col("_size"), "_filled")
        wanted = (F.col("_before") + have < share * r["n"]) & (F.col("_filled") + F.col("_size") <= room - used)
        taken = checkpointed(taken.unionByName(summed.where(wanted).select("_c")))
    for r in labels:
        mine = held.where(F.col("_l") == r["_l"]).join(taken, "_c", "left_semi")
        have = mine.agg(F.sum("_k")).first()[0] or 0
        excess = max(have - most_share * r["n"], least_train - (r["n"] - have))
        if have and excess > 0:
            summed = _with_running(mine, [F.col("_k").desc(), tie, F.col("_c")], F.col("_k"), "_before")
            back = summed.where(F.col("_before") < excess).select("_c")
            taken = checkpointed(taken.join(back, "_c", "left_anti"))
    chosen = taken.withColumn("_t", F.lit("eval"))
    return size.join(chosen, "_c", "left").select(F.col("_c").alias(component), F.coalesce("_t", F.lit("train")).alias("split"))


def segment_plan(components: DataFrame, component: str, size: str, segments: int) -> DataFrame:
    """``(component, size, segment)``: whole components in their order laid end to end and cut into segments of about the same size.

    A component belongs to the segment in which it starts; a null or negative size is 0.
    """
    rows = components.select(component, F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias(size)).distinct()
    total = rows.agg(F.sum(size)).first()[0] or 0
    placed = _with_running(rows, [F.col(component), F.col(size)], F.col(size), "_before")
    at = F.floor(F.col("_before") * segments / F.lit(max(total, 1)))
    return placed.select(component, size, F.least(at, F.lit(segments - 1)).cast("int").alias("segment"))
