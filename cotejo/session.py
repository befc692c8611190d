"""Session helpers: a local session for tests and the checkpoint location."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, app: str = "cotejo") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("COTEJO_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config(CHECKPOINT_KEY, os.environ.get("COTEJO_SHARED") or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names; only a local session without one gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
    if named:
        context.setCheckpointDir(named)
        return
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: bytes of an Arrow batch that goes to a Python worker, and Spark's setting for it
BATCH_BYTES, _BATCH_SETTING = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session sends texts to Python in batches of BATCH_BYTES, where it names no size of its own.

    Spark's own bound is 64 MB, which both the executor and the worker hold for every running task. Rows stay whole and no result depends on it.
    """
    if spark.conf.get(_BATCH_SETTING, "1b") == "1b":
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)
