"""Tables between the stages of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The setting by which Spark removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Folders written by this process.
WRITTEN: list[str] = []


def shared_place(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, or in local mode, where that is unset, below a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", "")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="ledgerweave-")
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at}/{label}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


def saved(df: DataFrame, label: str) -> DataFrame:
    """df, written below spark.checkpoint.dir and read again.

    For frames that an operator reads several times: what made them runs
    once, and lost executors don't bring it back.
    """
    spark = df.sparkSession
    path, before = shared_place(spark, label), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete what saved() and shared_place() have made so far; results that read it must have been written before."""
    while WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
