"""Session settings and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "trustlens", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the plans rely on (UTC, AQE with skew handling).

    ``master`` and ``shuffle_partitions`` are only for local runs; on a cluster they
    come from spark-submit and AQE coalesces the shuffle partitions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if not master and spark.conf.get(initial, None) is None:
        # start with many shuffle partitions; small ones are merged at run time
        spark.conf.set(initial, str(max(2000, 4 * spark.sparkContext.defaultParallelism)))
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under the cluster's shared checkpoint location.

    The location is read from ``spark.checkpoint.dir``. Only where that is unset and the
    session is local (tests) is a temporary folder of this machine used instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = os.path.join(tempfile.gettempdir(), "trustlens-scratch")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def set_aside(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the shared folder and read again: what is used several times is computed once and survives lost executors."""
    path = scratch_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable; a location set by the cluster is kept."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(scratch_dir(spark, "checkpoints"))
