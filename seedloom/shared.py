"""The folder that driver and executors share, for results that later jobs read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from seedloom.errors import ConfigError


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir. Only a local session can do without: driver and tasks are one
    machine there, and a temporary folder will do."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="seedloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/seedloom-{spark.sparkContext.applicationId}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write df below the shared folder and read it back: later jobs don't depend on executors' local disks, and a row
    is computed once even where its value depends on task order."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
