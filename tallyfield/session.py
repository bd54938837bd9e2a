"""Session settings, shared folder and materialisation."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_TASK = "spark.tallyfield.rowsPerTask"
DEFAULT_ROWS_PER_TASK = 4_000_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join is split even when that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Keyed state of streams, which has timers and lists only in this store.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

_local_scratch: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options the jobs rely on (UTC clock, AQE, skew joins)."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def rows_per_task(spark: SparkSession) -> int:
    """Rows one task may have to order; larger key groups are split."""
    return int(spark.conf.get(ROWS_PER_TASK, str(DEFAULT_ROWS_PER_TASK)))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read, named by ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="tallyfield-")
        atexit.register(shutil.rmtree, _local_scratch[app], True)
    return _local_scratch[app]


def stage_root(spark: SparkSession) -> str:
    """Folder of all intermediate tables of this application."""
    return f"{shared_dir(spark)}/tallyfield-{spark.sparkContext.applicationId}"


def release_stages(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; frames built on them end here."""
    root = spark._jvm.org.apache.hadoop.fs.Path(stage_root(spark))
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a plan is read several times or where a partition number has to stay
    the same for every reader, also after an executor is lost. What was shuffled for it
    is deleted with its last row.
    """
    return materialize_at(new_stage(df.sparkSession), [df])


def new_stage(spark: SparkSession) -> str:
    """A fresh place for an intermediate table."""
    return f"{stage_root(spark)}/stage-{uuid.uuid4().hex}"


def materialize_at(path: str, parts: Sequence[DataFrame]) -> DataFrame:
    """``materialize`` of several frames as one table, written one after the other at a new place."""
    spark = parts[0].sparkSession
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        for part in parts:
            part.write.mode("append").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(parts[0].schema).parquet(path)


def delete_stage(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def with_one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Put the columns of a one-row frame beside every row of ``df``."""
    constant = F.lit(1)
    return df.withColumn("_one", constant).join(F.broadcast(row.withColumn("_one", constant)), "_one").drop("_one")
