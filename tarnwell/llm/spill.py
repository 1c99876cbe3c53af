"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the cluster names one; a folder of this machine only in local mode, as in tests. On a cluster that names none this is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tarnwell-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows, written once as Parquet in the shared folder and read back, so that a lost executor costs no recomputation."""
    path = path or new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Cuts that are removed at the end of a ``with``; what is to outlive it is cut outside."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folders = spark, []

    def cut(self, df: DataFrame) -> DataFrame:
        self.folders.append(new_folder(self.spark))
        return cut(df, self.folders[-1])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for f in self.folders:
            remove(self.spark, f)
