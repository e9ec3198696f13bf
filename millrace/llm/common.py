"""Helpers that several operators share: table access, shared storage and Arrow batches."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch at most; texts run to many kilobytes, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_PACKAGE = __name__.split(".")[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder; any path Spark reads will do."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Python workers get BATCH_ROWS rows at a time, so that long texts don't fill them, and find this
    package: a local session's where the driver has it, a cluster's in an archive that is sent to them.
    Operators call this before they build what runs there."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    context = spark.sparkContext
    if not _is_local(spark) and context.applicationId not in _SENT:
        _SENT.add(context.applicationId)
        context.addPyFile(_archive(spark))


_SENT: set[str] = set()


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master.startswith("local") and "cluster" not in master


def _archive(spark: SparkSession) -> str:
    """The package as an archive in the shared folder."""
    data, package = io.BytesIO(), os.path.join(_ROOT, _PACKAGE)
    with zipfile.ZipFile(data, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, _ROOT))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{_PACKAGE}-{uuid.uuid4().hex}.zip")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = files.create(path)
    stream.write(data.getvalue())
    stream.close()
    files.deleteOnExit(path)
    return path.toString()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may go without it; then a temporary folder is used.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not _is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _LOCAL


_LOCAL: str | None = None


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to a table in the shared folder and reads that: it cuts the lineage, so a
    lost executor costs a read and not a second computation. Removed when the session ends."""
    spark = df.sparkSession
    prepare(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    _MADE.append(path)
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    return spark.read.schema(nullable).parquet(path)


#: Tables that materialize() made and nothing has deleted.
_MADE: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table that materialize() made and that nothing will read again."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def settle(build: Callable[[], DataFrame], label: str) -> DataFrame:
    """materialize(build()), and every table that was made on the way is deleted."""
    before = len(_MADE)
    out = materialize(build(), label)
    for path in _MADE[before:-1]:
        _delete(out.sparkSession, path)
    _MADE[before:-1] = []
    return out


def doc_columns(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id as a long and the text's UTF-8 bytes as ``raw``; other columns are left behind, so
    no name of theirs can clash."""
    prepare(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("raw"), *more)


def same(left: Column, right: Column) -> Column:
    """Equality that also holds for two nulls."""
    return left.eqNullSafe(right)


#: Keys of rows that are broadcast at most (some 50 MB); more are joined by shuffling.
BROADCAST_KEYS = 500_000


def text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"].cast("string"))


def rows_by_key(docs: DataFrame, keys: DataFrame, matching: bool, hashed: Column | None = None) -> DataFrame:
    """The rows of ``docs``, as struct ``row`` with ``id`` and ``hash``, whose (doc_id, text_hash) is
    among the keys, or is not; ``hashed``: another hash of the row that the keys go by. Nulls equal nulls.
    Texts aren't shuffled unless the keys are too many."""
    hashed = text_hash(docs) if hashed is None else hashed
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), hashed.alias("hash"))
    few = keys.count() <= BROADCAST_KEYS
    own = keys.select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"))
    return whole.join(F.broadcast(own) if few else own, same(F.col("id"), F.col("k_id")) & (F.col("hash") == F.col("k_hash")), "left_semi" if matching else "left_anti")


_HELD: dict = {}


def held(key: tuple, build: Callable):
    """A worker's large table: the one asked for last is kept, and makes way for the next."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def release() -> None:
    """Called by steps that need a worker's memory for something else."""
    _HELD.clear()


def broadcast_value(spark: SparkSession, value):
    """A Python value sent once to each executor; callers state why its size is bounded."""
    return spark.sparkContext.broadcast(value)


__all__ = ["BATCH_ROWS", "BROADCAST_KEYS", "broadcast_value", "doc_columns", "drop_table", "held", "materialize", "prepare", "release", "rows_by_key", "same", "settle", "shared_dir", "table", "text_hash"]
