"""Intermediate results in the folder that driver and executors share, so that lineage ends there and lost executors lose nothing."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark removes a statement's shuffle files when it has ended. What is written has no more need of them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the checkpoint folder of the context. Only where all runs on one machine (master local) it may be a folder of our own."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: intermediate results need a folder that all machines share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().rstrip("/")


@contextmanager
def without_shuffle_files(spark: SparkSession):
    """Statements within leave no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str = "step", files: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back. The path is noted in files, for `remove`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with without_shuffle_files(spark):
        df.write.parquet(path)
    if files is not None:
        files.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, files: list[str]) -> None:
    """Deletes results that nothing will read again, and forgets them."""
    context = spark.sparkContext
    jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
    while files:
        path = jvm.org.apache.hadoop.fs.Path(files.pop())
        path.getFileSystem(conf).delete(path, True)
