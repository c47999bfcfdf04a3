"""Panels: blocks joined to a base, facts under several names, calls and their rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assembled(base: DataFrame, blocks: dict[str, DataFrame], keys: list[str], zero_filled: tuple[str, ...] = ()) -> DataFrame:
    """``base`` with the columns of each block by ``keys``, and ``has_<block>``; rows of ``base`` are always kept.

    Missing values are 0 in ``zero_filled`` columns (counts and shares) and null
    in all others. A block with two rows for a key is an error in the data: the
    join would multiply, so blocks are aggregated by the caller. Columns that
    two sides share are an error.
    """
    taken = set(base.columns)
    out = base
    for name, block in blocks.items():
        own = [c for c in block.columns if c not in keys]
        if clash := taken & {*own, f"has_{name}"}:
            raise ValueError(f"block {name} repeats columns {sorted(clash)}")
        taken |= {*own, f"has_{name}"}
        out = out.join(block.withColumn(f"has_{name}", F.lit(True)), keys, "left")
    filled = {c: F.coalesce(c, F.lit(0)) for c in zero_filled}
    return out.withColumns(filled | {f"has_{n}": F.coalesce(f"has_{n}", F.lit(False)) for n in blocks})


def complete_rows(base: DataFrame, blocks: dict[str, DataFrame], keys: list[str], target: str) -> tuple[DataFrame, DataFrame]:
    """Rows with every block and a target, and one row of counts: how many lack each block (before the target is asked for) or the target."""
    marked = assembled(base, blocks, keys)
    lacks = {n: ~F.col(f"has_{n}") for n in blocks} | {"target": F.col(target).isNull()}
    counts = marked.agg(F.count("*").alias("n_base"), *(F.count_if(c).alias(f"n_without_{n}") for n, c in lacks.items()))
    whole = marked.where(~reduce(lambda a, b: a | b, lacks.values()))
    return whole.drop(*(f"has_{n}" for n in blocks)), counts


def family_facts(facts: DataFrame, families: DataFrame, as_of: Column, *, entity: str, concept: str, end: str, filed: str, tie: str, value: str, fresh_days: int) -> DataFrame:
    """``(entity, family, state, concept, value, end, newer_concept, newer_value)``: what was known of each family of concepts.

    The answer is the latest fact (by end, then filing day, then ``tie``) of the
    family's first concept. ``resolved``: at most ``fresh_days`` old on the day;
    ``stale``: older; ``partial``: only facts of other concepts are known;
    families of which nothing is known have no row. A fact of another concept is
    shown as newer only if its end is strictly later than the answer's; of equal
    ends that of the concept listed earlier counts.
    """
    known = facts.where(F.col(filed) <= as_of).join(families, concept)
    latest = known.groupBy(entity, "family", "preference", concept).agg(F.max(F.struct(F.col(end).alias("end"), F.col(filed).alias("filed"), F.col(tie).alias("tie"), F.col(value).alias("value"))).alias("f"))
    first = F.max(F.when(F.col("preference") == 1, F.struct(F.col(concept).alias("concept"), F.col("f"))))
    freshest = F.max(F.struct(F.col("f.end").alias("end"), (-F.col("preference")).alias("p"), F.col(concept).alias("concept"), F.col("f.value").alias("value")))
    g = latest.groupBy(entity, "family").agg(first.alias("a"), freshest.alias("n"))
    state = F.when(F.col("a").isNull(), "partial").when(F.date_diff(as_of, F.col("a.f.end")) <= fresh_days, "resolved").otherwise("stale")
    newer = F.col("a").isNull() | (F.col("n.end") > F.col("a.f.end"))
    return g.select(
        entity, "family", state.alias("state"), F.col("a.concept").alias("concept"), F.col("a.f.value").alias("value"), F.col("a.f.end").alias("end"),
        F.when(newer, F.col("n.concept")).alias("newer_concept"), F.when(newer, F.col("n.value")).alias("newer_value"),
    )


def chance_hits(n_up: Column, n_down: Column, share_up: Column) -> Column:
    """Expected hits of calls made without knowledge: up with the share of ups, down with the rest."""
    return n_up * share_up + n_down * (1 - share_up)


def entity_table(calls: DataFrame, entity: str, period: str, hit: Column, least: int) -> DataFrame:
    """``(entity, n_calls, n_hits, hit_rate, calls)``: the rate is withheld under ``least`` calls; ``calls`` are hits and calls of each period in order.

    Calls are counted per entity and period first, so an entity has no more
    rows than the calendar has periods, however many calls it has.
    """
    per = calls.groupBy(entity, period).agg(F.count("*").alias("n"), F.count_if(hit).alias("k"))
    label = F.concat(F.col(period).cast("string"), F.lit(":"), F.col("k").cast("string"), F.lit("/"), F.col("n").cast("string"))
    g = per.groupBy(entity).agg(F.sum("n").alias("n_calls"), F.sum("k").alias("n_hits"), F.array_sort(F.collect_list(F.struct(F.col(period).alias("p"), label.alias("l")))).alias("_c"))
    rate = F.when(F.col("n_calls") >= least, F.round(F.col("n_hits") / F.col("n_calls"), 6))
    return g.select(entity, "n_calls", "n_hits", rate.alias("hit_rate"), F.array_join(F.transform("_c", lambda c: c["l"]), " ").alias("calls"))


def contained(paragraph: Column, text: Column) -> Column:
    """Whether the paragraph stands in the text literally; both are normalised by the caller. Null without one of them."""
    return F.contains(text, paragraph)


def precision_recall(truth: Column, found: Column) -> list[Column]:
    """Counts, precision, recall and F1 as aggregates; a measure without a denominator is null."""
    both, t, f = F.count_if(truth & found), F.count_if(truth), F.count_if(found)
    return [
        t.alias("n_true"), f.alias("n_found"), both.alias("n_both"), F.round(F.try_divide(both, f), 6).alias("precision"), F.round(F.try_divide(both, t), 6).alias("recall"),
        F.round(F.try_divide(2 * both, t + f), 6).alias("f1"),
    ]


def first_by_rules(rows: DataFrame, key: str, rules: list[tuple[Column, str]], order: str) -> DataFrame:
    """``(key, order, confidence)``: of each key the first row by the first rule that any of its rows matches, with that rule's confidence.

    Rules are tried in turn; ``order`` decides between rows of one rule. A key
    that no rule matches keeps its place, with nulls.
    """
    rule = F.coalesce(*(F.when(c, i) for i, (c, _) in enumerate(rules)))
    best = rows.select(key, rule.alias("_rule"), order).groupBy(key).agg(F.min(F.when(F.col("_rule").isNotNull(), F.struct("_rule", order))).alias("b"))
    return best.select(key, F.col(f"b.{order}").alias(order), F.coalesce(*(F.when(F.col("b._rule") == i, name) for i, (_, name) in enumerate(rules))).alias("confidence"))


def first_of_path(rows: DataFrame, path: str, order: list[Column]) -> DataFrame:
    """One row per path, the first in order: what has to be fetched once."""
    w = Window.partitionBy(path).orderBy(*order)
    return rows.where(F.col(path).isNotNull()).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
