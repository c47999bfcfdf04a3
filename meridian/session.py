"""Session settings, table access and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "meridian") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _use_checkpoint_folder(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", "")
        if not shared:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="meridian-checkpoint-")
        sc.setCheckpointDir(shared)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
    local session without that setting gets a temporary folder of its own.
    """
    _use_checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the checkpoint folder, for tables and stream state that executors share."""
    _use_checkpoint_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``shared_folder`` gave."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan, at most 2**62.

    The estimate of a checkpoint is that of the plan it was made by, which joins
    multiply up: for those ``broadcast_if_few`` counts.
    """
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    try:
        return min(int(stats.sizeInBytes()), 1 << 62)
    except ValueError:  # more digits than Python converts
        return 1 << 62


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only while the estimated size is under ``limit``; beyond
    it the join is left to Catalyst, which shuffles."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


FEW_ROWS = 1_000_000


def broadcast_if_few(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """Hint a broadcast of a narrow table that is written already, such as a checkpoint, if it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df
