"""Session helpers: table access, and materialising rows in the folder that a cluster's machines share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; without that setting, a folder for tests or in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        folder = "file://" + tempfile.mkdtemp(prefix="capstrata-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"


def materialised(df: DataFrame) -> DataFrame:
    """The same rows behind a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
