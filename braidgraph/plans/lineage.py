"""Cutting lineage through shared storage.

Iterative operators write each step as a Parquet table below the checkpoint folder
of the cluster and read it back. The plan stays short, the step is computed once, a
lost executor only costs the tasks it held, and the file sizes give the optimizer
true statistics for the next join.
"""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="braidgraph-", dir="/tmp"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for intermediate data, grouped by application for later removal."""
    application = spark.sparkContext.applicationId
    return f"{checkpoint_folder(spark)}/braidgraph/{application}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of an execution go with its end, not when the driver collects garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared storage and return the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
