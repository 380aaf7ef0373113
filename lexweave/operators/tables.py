"""Intermediate tables: where they go, and cutting a plan at one."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolderError(RuntimeError):
    """A cluster's session names no folder that all executors reach."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor reaches: ``spark.checkpoint.dir``.

    Only a session on one machine that names none gets a temporary one; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise NoSharedFolderError("set spark.checkpoint.dir to a folder that all executors reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexweave-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables; Hadoop removes it when the application ends."""
    path = f"{shared_dir(spark)}/lexweave/{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Spark removes a query's shuffle files when it ends, instead of when the driver happens to collect its plan as garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Of what is written inside, the shuffle files go as soon as each table is there."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def snapshot(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once to the shared folder and read back, which cuts its lineage.

    The shuffle files of the plan go as soon as the table is written, so that a chain of tables holds on disk the
    shuffles of one plan and not of all.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
