"""Streams of files into the table store, and windowed aggregates over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import TableStore


def file_stream(spark: SparkSession, folder: str, schema: T.StructType | str, kind: str = "csv") -> DataFrame:
    """New files of a folder, each once."""
    reader = spark.readStream.schema(schema)
    return (reader.option("header", True).csv(folder) if kind == "csv" else reader.format(kind).load(folder)).withColumn("_ingested_via", F.lit("stream"))


def run_available(stream: DataFrame, store: TableStore, table: str, checkpoint: str) -> int:
    """Appends what has arrived, in one go; returns the rows added. A batch's number is part of its
    commit, so a batch that is repeated after a failure is not added again: only the latest commit of this
    stream is looked at, as batches come in order."""
    added, latest = 0, None

    def write(batch: DataFrame, number: int) -> None:
        nonlocal added
        nonlocal latest
        if latest is None:
            last = store.last_metrics(table, lambda m: m.get("batch", "").rpartition("#")[0] == checkpoint)
            latest = int(last["batch"].rpartition("#")[2]) if last else -1
        if number > latest and not batch.isEmpty():
            version = store.append(table, batch, merge_schema=True, metrics={"batch": f"{checkpoint}#{number}"})
            added += store.added_rows(table, version)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return added


def base_rows(df: DataFrame, evolved_column: str) -> DataFrame:
    """Rows from before a column was added."""
    return df.where(F.col(evolved_column).isNull()) if evolved_column in df.columns else df


def event_windows(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by window and type; as a stream, windows close once the watermark has passed them."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("events"), F.round(F.sum(F.col("value").cast("decimal(18,4)")), 2).cast("double").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "events", "total")
