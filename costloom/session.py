"""Session helper shared by tests, bench and ad-hoc jobs."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "8g", app: str = "costloom") -> SparkSession:
    """Local session; on a cluster the job is submitted with its own master and settings."""
    os.environ.setdefault("TZ", "UTC")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set, a local session (tests) gets a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not where:
        where = context.getCheckpointDir()
    if not where:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(where)
    return where


_made: list[str] = []


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it wants it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    files, where = file_system(spark, path)
    files.delete(where, True)


def new_dir(spark: SparkSession) -> str:
    """A path of its own in the shared folder; what is there goes at the end of the driver's program."""
    if not _made:
        atexit.register(_clear, spark)
    _made.append(f"{shared_dir(spark)}/costloom-{uuid.uuid4().hex}")
    return _made[-1]


def _clear(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        for path in _made:
            delete(spark, path)


def stored(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept as a table in the shared folder."""
    path = new_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
