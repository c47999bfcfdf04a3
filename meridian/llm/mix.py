"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridian.llm.rows import distinct_rows
from meridian.llm.tokenize import BYTE_BPE, TOKENIZERS, _blocks, vocabulary
from meridian.session import broadcast_if_few, checkpointed, shuffle_partitions

FAN_IN = 32


def token_counts(df: DataFrame, keys: list[str], text: str, tokenizers: str = TOKENIZERS, file: str = BYTE_BPE) -> DataFrame:
    """``keys`` and ``n_tokens`` of each row, 0 for null and empty texts; nothing is shuffled."""
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("n_tokens", T.LongType())])
    path = f"{tokenizers}/{file}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            counts: list[int] = []
            for block in _blocks(batch.column(len(keys)).to_pylist()):
                counts += vocab.count(block)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(counts, pa.int64())], names=[*keys, "n_tokens"])

    return df.select(*keys, F.col(text).alias("_text")).mapInArrow(run, schema)


def share_plan(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """``(source, normalised_share, expected_copies, max_repeats)``: expected copies of the documents of each source.

    ``sizes`` has source and n_tokens, ``targets`` source, target_share and
    max_repeats, one row a source. Shares are normalised over the sources that
    are on both sides, have tokens, and a positive share and number of repeats.
    Without ``total`` the mixture is as large as it can be with every source at
    its share: the source that is scarcest for its share is repeated up to its
    cap. With a larger ``total`` such sources stay at their cap and miss their
    share. Two numbers reach the driver, whatever the number of sources.
    """
    both = targets.where("target_share > 0 and max_repeats > 0").join(sizes.where("n_tokens > 0 and source is not null"), "source")
    both = checkpointed(both.select("source", "target_share", "max_repeats", "n_tokens"))
    # added up by decimals, so that no order of adding matters
    weight = both.agg(F.sum(F.col("target_share").cast("decimal(30,12)")).cast("double")).first()[0]
    share = F.col("target_share") / F.lit(weight)
    size = float(total) if total is not None else both.agg(F.min(F.col("max_repeats") * F.col("n_tokens") / share)).first()[0]
    expected = F.least(share * F.lit(size) / F.col("n_tokens"), F.col("max_repeats").cast("double"))
    near = F.round(expected)
    return both.select(
        "source", share.alias("normalised_share"), F.when(F.abs(expected - near) < 1e-9, near).otherwise(expected).alias("expected_copies"), "max_repeats"
    )


Unit = tuple[int, int]  # a document's id and a hash of its row: ids may come twice


def _uniform(seed: int, a: Unit, b: Unit) -> float:
    """A uniform number that depends on nothing but the seed and the two documents."""
    return xxhash.xxh64_intdigest(f"{seed}:{a}:{b}") / 2**64


def pivot(units: Iterator[tuple[Unit, float, float]], seed: int) -> tuple[list[tuple[Unit, int]], tuple[Unit, float, float] | None]:
    """Pivotal dependent rounding of ``(id, mass, probability)``.

    Pairs the unit in hand with the next one. Mass is moved from one to the other,
    in a random direction, until one of the two probabilities is 0 or 1; that
    one is decided, the other stays in hand. The sum of mass x probability
    stays the same, and so does each unit's expected value. Gives the decisions
    and the unit that is left undecided, if any.
    """
    decided: list[tuple[Unit, int]] = []
    hand: tuple[Unit, float, float] | None = None
    for unit in units:
        i, mass, p = unit
        if p <= 0.0 or p >= 1.0:
            decided.append((i, int(p >= 1.0)))
            continue
        if hand is None:
            hand = unit
            continue
        j, other, q = hand
        to_i = min((1 - p) * mass, q * other)
        to_j = min(p * mass, (1 - q) * other)
        if _uniform(seed, i, j) * (to_i + to_j) < to_j:  # so that nothing moves on average
            p, q, first = p + to_i / mass, q - to_i / other, (1 - p) * mass <= q * other
        else:
            p, q, first = p - to_j / mass, q + to_j / other, p * mass <= (1 - q) * other
        # exactly one is decided by the choice of the amount, whatever the rounding error
        if first:
            decided.append((i, int(p > 0.5)))
            hand = (j, other, min(max(q, 0.0), 1.0))
        else:
            decided.append((j, int(q > 0.5)))
            hand = (i, mass, min(max(p, 0.0), 1.0))
        if hand[2] <= 1e-12 or hand[2] >= 1 - 1e-12:
            decided.append((hand[0], int(hand[2] > 0.5)))
            hand = None
    return decided, hand


_ROUNDED = "doc long, row long, source string, mass double, extra int, p double, block int"


def _units(part: pd.DataFrame) -> list[tuple[Unit, float, float]]:
    return list(zip(zip(part["doc"].tolist(), part["row"].tolist()), part["mass"].tolist(), part["p"].tolist()))


def _round_groups(pdf: pd.DataFrame, seed: int, block: int) -> list[tuple]:
    """Round the units of each source of ``pdf``; the one left keeps its probability and has no decision."""
    out = []
    for source, part in pdf.groupby("source", sort=True):
        units = _units(part.sort_values(["doc", "row"], kind="stable"))
        masses = {u: m for u, m, _ in units}
        decided, left = pivot(iter(units), seed)
        out += [(*u, source, masses[u], x, float(x), block) for u, x in decided]
        if left is not None:
            out.append((*left[0], source, left[1], None, left[2], block))
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["doc", "row", "source", "mass", "extra", "p", "block"])
    return frame.astype({"extra": "Int32", "block": "int32", "doc": "int64", "row": "int64"})


def _node(seed: int, root: bool):
    """Combine the units left by up to ``FAN_IN`` partitions; at the root the last one is drawn."""

    def node(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _round_groups(pdf, seed, int(pdf["block"].iloc[0]))
        if root:
            rows = [(d, r, s, m, int(_uniform(seed, (d, r), (d, r)) < p) if x is None else x, p, b) for d, r, s, m, x, p, b in rows]
        return _frame(rows)

    return node


def round_copies(docs: DataFrame, seed: int = 20240101) -> DataFrame:
    """``(doc, row, source, extra)`` from ``(doc, row, source, mass, p)``: 1 for a share p of the mass of each source, else 0.

    Every partition rounds its own units and leaves at most one per source.
    Those are combined by a reduction tree with ``FAN_IN`` partitions to a node;
    the unit left at the root is drawn with its probability. So the mass chosen
    differs from the expected one by less than one document per source.
    Partitions are hashed and ordered by document and draws depend on documents
    alone: a lost partition comes out the same again.
    """
    n = shuffle_partitions(docs.sparkSession)

    def leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        hand: dict[str, tuple] = {}
        for batch in batches:
            rows = []
            for source, part in batch.groupby("source", sort=True):
                units = _units(part)
                if source in hand:
                    units.insert(0, hand[source])
                masses = {u: m for u, m, _ in units}
                decided, left = pivot(iter(units), seed)
                rows += [(*u, source, masses[u], x, float(x), block) for u, x in decided]
                if left is None:
                    hand.pop(source, None)
                else:
                    hand[source] = left
            yield _frame(rows)
        yield _frame([(*u, s, m, None, p, block) for s, (u, m, p) in sorted(hand.items())])

    leaves = docs.select("doc", "row", "source", "mass", "p").repartition(n, "doc").sortWithinPartitions("source", "doc", "row")
    level = checkpointed(leaves.mapInPandas(leaf, _ROUNDED))
    decided = [level.where("extra is not null")]
    undecided = level.where("extra is null")
    width = n
    while True:
        width = math.ceil(width / FAN_IN)
        last = width == 1

        grouped = undecided.withColumn("block", F.floor(F.col("block") / FAN_IN).cast("int")).groupBy("source", "block")
        level = checkpointed(grouped.applyInPandas(_node(seed, last), _ROUNDED))
        decided.append(level.where("extra is not null"))
        if last:
            break
        undecided = level.where("extra is null")
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    return out.select("doc", "row", "extra")


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    *,
    doc: str = "doc_id",
    source: str = "source",
    text: str = "text",
    total: int | None = None,
    seed: int = 20240101,
    tokenizers: str = TOKENIZERS,
    file: str = BYTE_BPE,
) -> tuple[DataFrame, DataFrame]:
    """``(doc, source, n_tokens, copies)`` of every document, and the plan (see ``share_plan``).

    ``targets`` has source, target_share and max_repeats; of repeated rows for a
    source the largest share and number count. Documents of a source that is
    null, has no target, or a target of 0, and documents without tokens get 0
    copies. A document gets the whole part of its source's expected copies, and
    one more by pivotal rounding of the fraction, with token mass kept; never
    more than max_repeats. Repeated rows count once; rows of one ``doc`` that
    differ in source or text are different documents and come out each. ``doc``
    must be an integral key. With nothing on both sides all get 0.
    """
    columns = (F.col(doc).cast("long").alias("doc"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = distinct_rows(documents.select(*columns), "doc").withColumn("row", F.xxhash64("source", F.col("source").isNull(), "text"))
    sized = checkpointed(token_counts(rows, ["doc", "row", "source"], "text", tokenizers, file))
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    sizes = sized.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"))
    plan = checkpointed(share_plan(sizes, wanted, total))
    whole = F.floor("expected_copies").cast("int")
    table = plan.select("source", whole.alias("whole"), (F.col("expected_copies") - whole).alias("p"))
    planned = sized.join(broadcast_if_few(table), "source", "left")
    used = (F.col("n_tokens") > 0) & F.col("whole").isNotNull()
    chosen = round_copies(planned.where(used & (F.col("p") > 0)).select("doc", "row", "source", F.col("n_tokens").cast("double").alias("mass"), "p"), seed)
    out = planned.join(chosen, ["doc", "row"], "left").select(
        F.col("doc").alias(doc),
        F.col("source").alias(source),
        "n_tokens",
        F.when(used, F.col("whole") + F.coalesce("extra", F.lit(0))).otherwise(0).cast("int").alias("copies"),
    )
    return out, plan


def mixture_report(copies: DataFrame, targets: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source of either side: its target, what it has, and the share of the mixture's tokens that it reached."""
    goal = plan.select("source", "normalised_share", "expected_copies")
    copies = checkpointed(copies)
    has = copies.groupBy("source").agg(
        F.count("*").alias("n_documents"),
        F.sum("n_tokens").alias("n_tokens"),
        F.count_if(F.col("copies") > 0).alias("n_used"),
        F.sum(F.col("copies").cast("long")).alias("n_copies"),
        F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"),
        F.max("copies").alias("most_copies"),
    )
    total = has.agg(F.sum("mixed_tokens")).first()[0] or 0
    asked = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    share = F.col("mixed_tokens") / F.lit(float(total)) if total else F.lit(0.0)
    return (
        has.join(asked, "source", "full")
        .join(broadcast_if_few(goal), "source", "left")
        .withColumn("share_reached", F.coalesce(share, F.lit(0.0)))
    )

