"""The folder that driver and executors share, and tables that cut a plan in two there."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session may go without it, and then uses a temporary folder that goes
    with the process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + _scratch().name
    return shared.rstrip("/")


@functools.cache
def _scratch() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="millrace-store-", ignore_cleanup_errors=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table that is written once, so that every later job sees them dealt and numbered alike, whatever
    task or executor is lost. It goes when the session ends."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}")
    df.write.parquet(path.toString())
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path.toString())
