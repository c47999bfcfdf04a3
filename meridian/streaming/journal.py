"""Append-only journals: resumable processing, torn tails, last write wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_journal(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON-lines journal; a torn or foreign line is dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def replay(journal: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key, by ``order``."""
    rest = [c for c in journal.columns if c not in keys]
    last = journal.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_r"))
    return last.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def remaining(work: DataFrame, journal: DataFrame, keys: list[str], digest: str | None = None) -> DataFrame:
    """Work without a record in the journal. With ``digest``, a record made under another digest is an error."""
    if digest is not None:
        stale = work.join(journal.select(*keys, F.col(digest).alias("_d")), keys).where(~F.col(digest).eqNullSafe(F.col("_d")))
        if not stale.isEmpty():
            raise ValueError(f"the journal has records made under another {digest}")
    return work.join(journal.select(*keys).distinct(), keys, "left_anti")


def process_stream(
    spark: SparkSession, source: str, schema: StructType | str, out: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], keys: list[str], files_per_trigger: int = 64
) -> None:
    """Process what is new in a folder of parquet files and append it to a journal, then stop.

    At least once: a batch that is repeated after a failure is written to the
    folder of its batch number again, over what was there, so each record
    counts once. ``keys`` drops repeated records within a batch.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        step(batch.dropDuplicates(keys)).write.mode("overwrite").json(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def progress(journal: DataFrame, by: list[str], ok: str, seconds: str) -> DataFrame:
    """Totals of a journal: records, failures and time."""
    return journal.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~F.col(ok)).alias("n_failed"), F.round(F.sum(seconds), 3).alias("seconds"))
