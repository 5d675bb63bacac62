"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir. Where that is not set, a session on one machine gets one of its own; on
    a cluster it is an error, since executors do not see each other's folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        root = "/tmp/checkpoints"
    return f"{root}/rankflow-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of df as a table in the shared folder: cuts lineage, and survives the loss of executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
