"""Sinks: keyed upserts, scoped replacement, completion of missing values, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def conform(rows: DataFrame, schema: StructType) -> DataFrame:
    """``rows`` in the columns and types of ``schema``; a column that is missing or left over is an error."""
    if set(rows.columns) != set(schema.names):
        raise ValueError(f"columns differ: {sorted(set(rows.columns) ^ set(schema.names))}")
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def replace_scope(rows: DataFrame, path: str, scope: list[str]) -> None:
    """Replace the partitions of ``path`` that ``rows`` has values of, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scope).parquet(path)


def completed(target: DataFrame, completion: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``target`` with nulls of ``columns`` filled from ``completion``. A key that is unknown, or has nothing to fill, is an error."""
    unknown = completion.join(target.select(*keys), keys, "left_anti")
    full = completion.join(target.where(" and ".join(f"`{c}` is not null" for c in columns)).select(*keys), keys, "left_semi")
    if not unknown.isEmpty() or not full.isEmpty():
        raise ValueError("completion has keys that are unknown or have nothing to fill")
    extra = completion.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = target.join(extra, keys, "left")
    return joined.select(*(F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in target.columns))


def digest(rows: DataFrame) -> tuple[int, str]:
    """Number of rows and a digest of their content that does not depend on their order."""
    row = F.xxhash64(*(F.col(c) for c in sorted(rows.columns)))
    r = rows.agg(F.count("*").alias("n"), F.bit_xor(row).alias("x"), F.sum(row.cast("decimal(38,0)")).alias("s")).first()
    return r["n"], f"{(r['x'] or 0) & (2**64 - 1):016x}-{int(r['s'] or 0) & (2**64 - 1):016x}"


def write_with_manifest(rows: DataFrame, path: str, inputs: dict[str, DataFrame]) -> dict:
    """Write parquet, and beside it a manifest with the digests of inputs and output; gives the manifest."""
    rows.write.mode("overwrite").parquet(path)
    spark = rows.sparkSession
    n, d = digest(spark.read.parquet(path))
    manifest = {"rows": n, "digest": d, "schema": rows.schema.simpleString(), "inputs": {k: dict(zip(("rows", "digest"), digest(v))) for k, v in inputs.items()}}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.manifest")
    return manifest


def same_as_manifest(rows: DataFrame, manifest: dict) -> bool:
    """Whether the rows are those that the manifest was written for."""
    return digest(rows) == (manifest["rows"], manifest["digest"])


def write_shard(rows: DataFrame, path: str, shard: int, run: str) -> bool:
    """Write one shard unless this run has finished it; true if it was written.

    A marker with the run and the number of rows is written after the data, so
    a shard that was interrupted is written again.
    """
    spark = rows.sparkSession
    done = _markers(spark, path)
    if any(r["shard"] == shard and r["run"] == run for r in done):
        return False
    rows.write.mode("overwrite").parquet(f"{path}/data/shard={shard}")
    n = spark.read.parquet(f"{path}/data/shard={shard}").count()
    spark.createDataFrame([(shard, run, n)], "shard int, run string, n long").coalesce(1).write.mode("overwrite").json(f"{path}/done/{shard}")
    return True


def _markers(spark, path: str) -> list:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/done")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return []
    return spark.read.schema("shard int, run string, n long").option("recursiveFileLookup", True).json(f"{path}/done").collect()


def merged_shards(spark, path: str, shards: int, run: str) -> DataFrame:
    """All shards of a run; missing ones, or a number of rows other than the markers', are errors."""
    done = {r["shard"]: r["n"] for r in _markers(spark, path) if r["run"] == run}
    if missing := sorted(set(range(shards)) - set(done)):
        raise ValueError(f"shards {missing[:20]} are not done")
    rows = spark.read.parquet(*(f"{path}/data/shard={s}" for s in range(shards)))
    if (n := rows.count()) != sum(done[s] for s in range(shards)):
        raise ValueError(f"{n} rows, but the markers say {sum(done.values())}")
    return rows


def write_vectors(rows: DataFrame, path: str, column: str, width: int) -> None:
    """Write parquet with a column of float vectors that all have ``width`` elements and no nulls among them; a null vector is allowed."""
    v = F.col(column)
    bad = rows.where(v.isNotNull() & ((F.size(v) != width) | F.exists(v, lambda x: x.isNull()))).count()
    if bad:
        raise ValueError(f"{bad} vectors are not {width} floats")
    rows.withColumn(column, v.cast("array<float>")).write.mode("overwrite").parquet(path)


def write_report(rows: DataFrame, path: str, order: list[str], form: str = "csv") -> None:
    """Write a small table as one sorted CSV (with a header) or JSON file."""
    out = rows.orderBy(*order).coalesce(1).write.mode("overwrite")
    out.option("header", True).csv(path) if form == "csv" else out.json(path)


def _stamp(version: str, inputs: dict[str, DataFrame]) -> str:
    return json.dumps({"version": version, "inputs": {k: list(digest(v)) for k, v in sorted(inputs.items())}}, sort_keys=True)


def is_fresh(spark, path: str, version: str, inputs: dict[str, DataFrame]) -> bool:
    """Whether the table at ``path`` was built by this version from inputs with the same content."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.stamp")
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return there.exists(hadoop) and [r["value"] for r in spark.read.text(f"{path}.stamp").collect()] == [_stamp(version, inputs)]


def cached_table(spark, path: str, version: str, inputs: dict[str, DataFrame], build) -> DataFrame:
    """The table at ``path`` if it was built by this version from inputs with the same content; else it is built and written anew.

    ``build`` takes nothing and gives the rows. The stamp is written after the
    rows, so a table whose writing was interrupted is built again.
    """
    stamp, mark = _stamp(version, inputs), f"{path}.stamp"
    if is_fresh(spark, path, version, inputs):
        return spark.read.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(mark)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    build().write.mode("overwrite").parquet(path)
    spark.createDataFrame([(stamp,)], "value string").coalesce(1).write.mode("overwrite").text(mark)
    return spark.read.parquet(path)


def write_shards(rows: DataFrame, path: str, key: str, shards: int, run: str) -> DataFrame:
    """Write ``rows`` in shards by a hash of the key, those that this run has finished left alone, and give the merged table.

    A run that was interrupted goes on where it stopped if it is called again.
    """
    shard = F.pmod(F.xxhash64(key), F.lit(shards))
    for i in range(shards):
        write_shard(rows.where(shard == i), path, i, run)
    return merged_shards(rows.sparkSession, path, shards, run)


def write_markdown(rows: DataFrame, path: str, order: list[str], title: str, most: int = 1000) -> None:
    """Write a small sorted table as one Markdown file; a table of more than ``most`` rows is no report and is refused."""
    found = rows.orderBy(*order).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    text = "\n".join([f"# {title}", "", line(rows.columns), line(["-"] * len(rows.columns)), *(line(map(cell, r)) for r in found)])
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def ordered_json(blocks: list[tuple[str, object]], order: list[str]) -> str:
    """A JSON object of blocks that must come in the given order, each once; anything else is refused."""
    names = [n for n, _ in blocks]
    if names != [n for n in order if n in names] or len(set(names)) != len(names):
        raise ValueError(f"blocks {names} are not in the order {order}")
    return json.dumps(dict(blocks))
