"""Folders that the driver and all executors share, for tables between two plans and files of streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _file(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or a local one under a local master only; it goes with the driver."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessella-")
    folder = f"{root.rstrip('/')}/graph-{uuid.uuid4().hex}"
    path, system = _file(spark, folder)
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


def remove(spark: SparkSession, name: str) -> None:
    path, system = _file(spark, name)
    system.delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table of its own: what reads it twice doesn't compute it twice."""
    path = f"{shared_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
