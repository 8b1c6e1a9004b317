"""Session settings that the library's plans expect, and tables stored between steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}
#: where stored tables go if the session names no folder and runs on one machine, as in tests
LOCAL_FOLDER = "/tmp/checkpoints"


def session(name: str = "tessella", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in {**SETTINGS, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own is taken only where none is set and Spark runs on one machine."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{LOCAL_FOLDER}"
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used."""
    return f"{work_folder(spark)}/tessella-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
