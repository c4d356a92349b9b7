"""Tables in the folder that the cluster shares."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a session in one process may go without it; on a cluster other machines see no local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set; on a cluster it has to name a folder that all machines share")
        root = f"{tempfile.gettempdir()}/hippospark-{os.getpid()}"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage is cut and lost executors don't matter."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Delete a table that saved() wrote, once nothing reads it."""
    remove(df.sparkSession, df.saved_path)


def tidy(spark: SparkSession) -> None:
    """Let go of finished plans, so that Spark's cleaner deletes their shuffle files; otherwise they stay until the JVM happens to collect."""
    for _ in range(2):  # what the first pass finds unreachable lets go of more
        gc.collect()
        spark._jvm.System.gc()
