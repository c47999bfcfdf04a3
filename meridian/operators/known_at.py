"""Attributes as they were known at the time of an event."""

from __future__ import annotations


import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.session import shuffle_partitions

_ASOF = """
with version as (  -- the state current from each day of availability on
  select entity, available,
         max(state) over (partition by entity order by available
                          rows between unbounded preceding and current row) as state
  from fact)
select e.entity as entity, e.at as at, v.state.effective as effective, v.state.disclosed as disclosed,
       nullif(v.state.source, '') as source, v.state.val as val
from event e asof left join version v on e.entity = v.entity and e.at > v.available
"""
_OUT = "entity long, at date, effective date, disclosed date, source string, val double"


def _asof_bucket(events: pa.Table, facts: pa.Table) -> pa.Table:
    """One hash bucket of entities: DuckDB's ASOF LEFT JOIN on ordered versions."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    try:
        con.register("event", events.select(["entity", "at"]))
        con.register("fact", facts.select(["entity", "available", "state"]))
        found = con.sql(_ASOF).to_arrow_table()
    finally:
        con.close()
    schema = pa.schema(
        [("entity", pa.int64()), ("at", pa.date32()), ("effective", pa.date32()), ("disclosed", pa.date32()), ("source", pa.string()), ("val", pa.float64())]
    )
    return found.select(schema.names).cast(schema)


def known_states(
    events: DataFrame,
    facts: DataFrame,
    *,
    entity: str,
    at: str,
    effective: str,
    disclosed: str,
    source: str,
    value: str,
    buckets: int | None = None,
) -> DataFrame:
    """``(entity, at, effective, disclosed, source, val)``: one row per distinct (entity, at).

    A fact is known at ``at`` if both its ``effective`` and its ``disclosed``
    day are earlier. Of those known, the latest ``effective`` counts, then the
    latest ``disclosed``, then the largest ``source``, then the largest value;
    zero is a value like others. With nothing known the four columns are null.
    Facts without a day of either kind, and facts or events of a null entity,
    are known to nobody: such events come out with nulls. Events without a day
    come out with nulls too. Repeated rows count once. ``entity`` must be integral.

    Two reductions before anything is grouped keep every entity small: events
    become distinct (entity, day) pairs, and facts that became available on one
    day become the best of them (ties are resolved there, before the join). An
    entity then has at most one row per calendar day on either side, so a hash
    bucket of entities stays small even if one entity has a third of all rows.
    There are as many buckets as shuffle partitions.
    """
    n = buckets or shuffle_partitions(events.sparkSession)
    ev = events.select(F.col(entity).cast("long").alias("entity"), F.col(at).cast("date").alias("at")).distinct()
    state = F.struct(
        F.col(effective).cast("date").alias("effective"),
        F.col(disclosed).cast("date").alias("disclosed"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.col(value).cast("double").alias("val"),
    )
    known = facts.select(F.col(entity).cast("long").alias("entity"), state.alias("state"))
    known = known.where(
        F.col("entity").isNotNull() & F.col("state.effective").isNotNull() & F.col("state.disclosed").isNotNull()
    ).withColumn("available", F.greatest("state.effective", "state.disclosed"))
    known = known.groupBy("entity", "available").agg(F.max("state").alias("state"))
    bucket = F.pmod(F.xxhash64("entity"), F.lit(n)).cast("int").alias("bucket")
    # a number of partitions that is asked for is kept: the rows are few, but the work on them is not
    left = ev.select(bucket, "entity", "at").repartition(n, "bucket").groupBy("bucket")
    right = known.select(bucket, "entity", "available", "state").repartition(n, "bucket").groupBy("bucket")
    return left.cogroup(right).applyInArrow(_asof_bucket, _OUT)


def with_known(
    events: DataFrame,
    facts: DataFrame,
    *,
    entity: str,
    at: str,
    effective: str,
    disclosed: str,
    source: str,
    value: str,
    prefix: str = "known_",
    buckets: int | None = None,
) -> DataFrame:
    """``events``, each row with the state known at its time in ``<prefix>effective``,
    ``<prefix>disclosed``, ``<prefix>source`` and ``<prefix>val`` (see ``known_states``).

    Rows of ``events`` are kept as they are, repeated ones included. Columns of
    ``events`` that already have one of these names are an error.
    """
    names = [prefix + x for x in ("effective", "disclosed", "source", "val")]
    if clash := set(names) & set(events.columns):
        raise ValueError(f"events already has {sorted(clash)}; choose another prefix")
    states = known_states(
        events, facts, entity=entity, at=at, effective=effective, disclosed=disclosed, source=source, value=value, buckets=buckets
    ).where("effective is not null")
    right = states.select(
        F.col("entity").alias("_known_entity"),
        F.col("at").alias("_known_at"),
        *(F.col(x).alias(prefix + x) for x in ("effective", "disclosed", "source", "val")),
    )
    on = (F.col(entity).cast("long") == F.col("_known_entity")) & (F.col(at).cast("date") == F.col("_known_at"))
    return events.join(right, on, "left").drop("_known_entity", "_known_at")
