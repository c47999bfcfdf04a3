"""Quantities recorded in different units and scales, converted to common units."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from meridian.functions.units import conversion, stated_currency
from meridian.session import broadcast_if_few, broadcast_if_small, checkpointed

_RESULT = [("common_unit", pa.string()), ("text_number", pa.float64()), ("exponent", pa.int32()), ("coefficient", pa.float64()), ("offset", pa.float64()), ("status", pa.string())]
_TYPES = {pa.string(): T.StringType(), pa.float64(): T.DoubleType(), pa.int32(): T.IntegerType()}
_SCHEMA = T.StructType([*(T.StructField(n, _TYPES[t]) for n, t in _RESULT), T.StructField("stated", T.StringType())])


@arrow_udf(_SCHEMA)
def _convert(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Conversions of (unit, text, common unit), and the currency that is stated; each different triple of a batch is parsed once."""
    for batch in batches:
        seen: dict[tuple, int] = {}
        at = pa.array([seen.setdefault(k, len(seen)) for k in zip(*(c.to_pylist() for c in batch))], pa.int32())
        cols = list(zip(*(conversion(*k) for k in seen))) or [()] * len(_RESULT)
        arrays = [pa.array(c, t).take(at) for c, (_, t) in zip(cols, _RESULT)]
        arrays.append(pa.array([stated_currency(*k[:2]) for k in seen], pa.string()).take(at))
        yield pa.StructArray.from_arrays(arrays, names=[*(n for n, _ in _RESULT), "stated"])


def _usual_currency(rows: DataFrame, entity: str) -> DataFrame:
    """``(_entity, _usual)``: the currency most facts of an entity state, null if two are as frequent.

    Counted per entity and currency before the shuffle, so no entity is gathered.
    """
    counts = rows.where(F.col("_c.stated").isNotNull() & F.col(entity).isNotNull()).groupBy(F.col(entity).alias("_entity"), F.col("_c.stated").alias("stated")).agg(F.count("*").alias("n"))
    best = counts.groupBy("_entity").agg(F.max("n").alias("most"), F.collect_list(F.struct("n", "stated")).alias("all"))
    first = F.filter("all", lambda x: x["n"] == F.col("most"))
    return best.select("_entity", F.when(F.size(first) == 1, first[0]["stated"]).alias("_usual"))


def _magnitudes(facts: DataFrame, group: list[str], tolerance: float) -> DataFrame:
    """Groups with facts at a thousandth or a millionth of the others, which agree: ``(group, _top)``.

    Values are first counted in narrow logarithmic bins per group, combined
    before the shuffle; a group then has no more rows than the range of doubles
    has bins, so a group with a third of all facts is as small as any other.
    """
    size = F.abs("_v")
    binned = facts.where(size > 0).withColumn("_bin", F.floor(F.log10(size) * 40))
    bins = binned.groupBy(*group, F.signum("_v").alias("_sign"), "_bin").agg(
        F.min(size).alias("lo"), F.max(size).alias("hi"), F.count("*").alias("n")
    )
    per = bins.groupBy(*group, "_sign").agg(
        F.collect_list(F.struct("lo", "hi", "n")).alias("_bins"), F.max("hi").alias("_top"), F.sum("n").alias("_n")
    )
    top = F.col("_top")

    def within(power: int):
        near = lambda b: (b["lo"] * F.lit(10.0**power) >= top * (1 - tolerance)) & (
            b["hi"] * F.lit(10.0**power) <= top * (1 + tolerance)
        )
        return F.aggregate(F.filter("_bins", near), F.lit(0).cast("long"), lambda s, b: s + b["n"])

    low = within(3) + within(6)
    agree = (within(0) >= 2) & (low > 0) & (within(0) + low == F.col("_n"))
    return per.where(agree).select(*group, "_sign", "_top")


def to_common_units(
    facts: DataFrame,
    common: DataFrame,
    *,
    fact: str = "fact_id",
    unit: str = "unit",
    value: str = "value",
    text: str = "value_text",
    concept: tuple[str, ...] = ("taxonomy", "concept"),
    period: tuple[str, ...] = ("cik", "concept", "period_start", "period_end"),
    entity: str = "cik",
    tolerance: float = 0.1,
) -> DataFrame:
    """``(fact, common_unit, number, exponent, common_value, status)`` per distinct fact.

    ``number`` is ``value``, or the number in ``text`` where ``value`` is null;
    ``common_value = (number * coefficient + offset) * 10 ** exponent`` (see
    ``functions.units``). ``exponent`` is that of the unit, or of the text if it
    states a scale. A fact that by unit and text is in the common unit, but
    whose number is a thousandth or a millionth of the at least two other facts
    of its ``period``, which agree within ``tolerance``, gets 3 or 6.

    A fact that needs a currency and names none (cents alone) is in the one that
    most facts of its ``entity`` state.

    Repeated rows count once. A fact without any number has a null
    ``common_value`` and status ``no_number``; a concept missing from ``common``
    or null, and units that the grammar does not know, give ``unknown_unit``;
    other dimensions than the common unit's give ``incompatible``; the value of
    either is null. Null units say nothing. Rows of ``common`` repeated for a
    concept must agree on the unit; the smallest is taken.
    """
    keys = list(dict.fromkeys([fact, unit, value, text, *concept, *period, entity]))
    rows = facts.select(*keys).distinct()
    target = common.groupBy(*concept).agg(F.min("common_unit").alias("_common"))
    rows = rows.join(broadcast_if_small(target), list(concept), "left")
    rows = rows.withColumn("_c", _convert(F.col(unit), F.col(text), F.col("_common")))
    rows = rows.withColumn("_number", F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(None)), F.col("_c.text_number")))
    ok = F.col("_c.status") == "ok"
    rows = rows.withColumn(
        "_v", F.when(ok, (F.col("_number") * F.col("_c.coefficient") + F.col("_c.offset")) * F.pow(F.lit(10.0), F.col("_c.exponent")))
    )
    group = [F.coalesce(F.col(p).cast("string"), F.lit("")).alias(f"_g{i}") for i, p in enumerate(period)]
    # the result of the parsing is read three times
    rows = checkpointed(rows.select("*", *group, F.signum("_v").alias("_sign")))
    names = [f"_g{i}" for i in range(len(period))]
    usual = _usual_currency(rows, entity)
    odd = _magnitudes(rows.where(F.col("_v").isNotNull()), names, tolerance)
    rows = rows.join(odd, [*names, "_sign"], "left")
    rows = rows.join(broadcast_if_few(checkpointed(usual)), F.col(entity) == F.col("_entity"), "left")
    own = F.regexp_extract("_c.common_unit", "^([A-Z]{3})(?:/|$)", 1)
    assumed = F.col("_c.stated").isNull() & (own != "") & F.col("_usual").isNotNull()
    common_unit = F.when(assumed, F.regexp_replace("_c.common_unit", "^[A-Z]{3}", F.col("_usual"))).otherwise(F.col("_c.common_unit"))
    claims = ok & (F.col("_c.exponent") == 0)
    near = lambda p: F.abs(F.abs("_v") * F.lit(10.0**p) / F.col("_top") - 1) <= tolerance
    shift = F.when(claims & near(3), 3).when(claims & near(6), 6).otherwise(0)
    return rows.withColumn("_shift", F.coalesce(shift, F.lit(0))).select(
        F.col(fact),
        common_unit.alias("common_unit"),
        F.col("_number").alias("number"),
        (F.col("_c.exponent") + F.col("_shift")).cast("int").alias("exponent"),
        (F.col("_v") * F.pow(F.lit(10.0), F.col("_shift"))).alias("common_value"),
        F.when(ok & F.col("_number").isNull(), "no_number").otherwise(F.col("_c.status")).alias("status"),
    )
