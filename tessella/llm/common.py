"""What the operators of this subpackage share on the Spark side."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Where checkpoints go if the session names no folder and runs on one machine, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: most rows and bytes of texts that a Python worker gets at once, a longer text alone: numpy holds several words per byte of them
BATCH_ROWS = 500
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, and bounds Arrow batches.

    Both hold for the session from then on; smaller bounds that it has already stay. On a cluster whose nodes lack the
    package, submit it with --py-files instead.
    """
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, path) if x)
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. A folder of our own is taken only where none is set and Spark runs on one machine."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{LOCAL_CHECKPOINTS}"
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessella-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def widened(schema: StructType, ddl: str) -> StructType:
    """The schema with further columns."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])
