"""Frames written to the folder that driver and executors share, so that a lost executor loses nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, as in tests, one in the warehouse.

    The warehouse is the one other place that a cluster shares by contract. On a cluster
    it is refused if it lies on a machine's own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if folder is None:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        alone = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        if not alone and (folder.startswith("file:") or "://" not in folder):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/sparkweave-{spark.sparkContext.applicationId}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again; its files stay until ``clean``."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Delete what this application has saved; frames that still read it can't be used afterwards."""
    delete(spark, own_folder(spark))
