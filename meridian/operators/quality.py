"""Invariants as data: each check counts the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_key(name: str, rows: DataFrame, keys: list[str], severity: str = "FATAL") -> DataFrame:
    """Keys that stand in more than one row."""
    many = rows.groupBy(*keys).count().where("count > 1")
    return many.agg(F.count("*").alias("n_bad")).select(F.lit(name).alias("check"), F.lit(severity).alias("severity"), "n_bad")


def no_rows(name: str, rows: DataFrame, bad: Column, severity: str = "FATAL") -> DataFrame:
    """Rows for which ``bad`` holds; null is not bad."""
    return rows.agg(F.count_if(bad).alias("n_bad")).select(F.lit(name).alias("check"), F.lit(severity).alias("severity"), "n_bad")


def no_orphans(name: str, rows: DataFrame, parents: DataFrame, keys: list[str], severity: str = "WARN") -> DataFrame:
    """Distinct keys without a parent."""
    lost = rows.select(*keys).where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))).distinct().join(parents.select(*keys).distinct(), keys, "left_anti")
    return lost.agg(F.count("*").alias("n_bad")).select(F.lit(name).alias("check"), F.lit(severity).alias("severity"), "n_bad")


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def with_exceptions(problems: DataFrame, exceptions: DataFrame, keys: list[str]) -> DataFrame:
    """``problems`` with ``severity`` lowered to INFO where an exception covers the keys; ``excepted`` says so."""
    known = exceptions.select(*keys).distinct().withColumn("_known", F.lit(True))
    joined = problems.join(known, keys, "left")
    excepted = F.coalesce("_known", F.lit(False))
    return joined.withColumn("excepted", excepted).withColumn("severity", F.when(excepted, "INFO").otherwise(F.col("severity"))).drop("_known")


def enforce(problems: DataFrame, limit: int = 20) -> None:
    """Raise if a FATAL check has bad rows; names of at most ``limit`` checks are given."""
    bad = problems.where("severity = 'FATAL' and n_bad > 0").limit(limit).collect()
    if bad:
        raise AssertionError("; ".join(f"{r['check']}: {r['n_bad']}" for r in bad))


def drift(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``(keys, change)``: rows ``added``, ``removed`` or ``changed`` between two versions; nulls are equal to nulls."""
    a = old.select(*keys, F.struct(*columns).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(*keys, F.struct(*columns).alias("_new"), F.lit(True).alias("_in_new"))
    both = a.join(b, keys, "full")
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.withColumn("change", change).where("change is not null").select(*keys, "change")


def one_owner(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """``(key, owner)``; a key with more than one owner is an error."""
    pairs = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(owner).alias(owner), F.max(owner).alias("_other"))
    bad = pairs.where(~F.col(owner).eqNullSafe(F.col("_other"))).limit(5).collect()
    if bad:
        raise AssertionError(f"keys with several owners, among them {[r[key] for r in bad]}")
    return pairs.drop("_other")


def attached(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """``rows`` with the owner of their key; a row without one is an error."""
    lost = rows.join(owners, key, "left_anti").limit(5).collect()
    if lost:
        raise AssertionError(f"keys without an owner, among them {[r[key] for r in lost]}")
    return rows.join(owners, key)


def assert_digests(tables: dict[str, DataFrame], expected: dict[str, tuple[int, str]]) -> None:
    """Refuse tables whose content is not the expected one (see ``sinks.digest``); a table that is not expected, or missing, is refused too."""
    from meridian.sources.sinks import digest

    if set(tables) != set(expected):
        raise AssertionError(f"tables differ: {sorted(set(tables) ^ set(expected))}")
    if bad := sorted(n for n, t in tables.items() if digest(t) != tuple(expected[n])):
        raise AssertionError(f"content differs: {bad}")


def validated(params: dict, types: dict[str, type], checks: dict | None = None) -> dict:
    """``params`` if every one is there, of its type and passes its check; there are no defaults, and nothing may be left over."""
    faults = [f"missing: {n}" for n in types if n not in params] + [f"unknown: {n}" for n in params if n not in types]
    for n, kind in types.items():
        if n in params and (not isinstance(params[n], kind) or (isinstance(params[n], bool) and kind is not bool)):
            faults.append(f"{n}: {type(params[n]).__name__} is no {kind.__name__}")
        elif n in params and checks and n in checks and not checks[n](params[n]):
            faults.append(f"{n}: {params[n]!r} is not allowed")
    if faults:
        raise ValueError("; ".join(faults))
    return params


def assert_one_variant(rows: DataFrame, expected: dict[str, object]) -> None:
    """Refuse rows that were made under another configuration; nulls differ from every value."""
    if expected:
        r = rows.agg(*(F.count_if(~F.col(c).eqNullSafe(F.lit(v))).alias(c) for c, v in expected.items())).first()
        if bad := {c: r[c] for c in expected if r[c]}:
            raise AssertionError(f"rows of another variant: {bad}")


def assert_count(name: str, rows: DataFrame, expected: int) -> DataFrame:
    """``rows``, if there are as many as were counted before; a census that has changed is refused, not adapted to."""
    if (n := rows.count()) != expected:
        raise AssertionError(f"{name}: {n} rows, not {expected}")
    return rows
