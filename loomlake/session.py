"""Session helpers: one place for the settings that a run needs and for the folder all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LOOMLAKE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only on a local master (tests, one machine) a temporary one is made where it is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    known = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="loomlake-")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A path of its own below the shared folder, in the application's folder."""
    return f"{shared_root(spark)}/loomlake/{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex}"


#: Shuffle files go when the write that needed them has ended: nothing reads them again, and the collector may come late.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Cut the lineage by a table in the shared folder: it outlives any executor and is compressed at rest. The shuffle files of the write are deleted."""
    spark = df.sparkSession
    path = shared_path(spark, purpose)
    before = spark.conf.get(_FREE)
    spark.conf.set(_FREE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_FREE, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Deletes tables made by ``written`` that no later step reads."""
    for df in frames:
        _delete(df.sparkSession, df._written_at)


def sweep(spark: SparkSession) -> None:
    """Deletes all that this application left below the shared folder: for when its results have been read or written elsewhere."""
    _delete(spark, f"{shared_root(spark)}/loomlake/{spark.sparkContext.applicationId}")
