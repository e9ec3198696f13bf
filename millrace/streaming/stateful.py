"""Streams with state: repeats dropped within a watermark, sessions, and two streams joined by an interval.

Each function takes a stream or a table, and gives for the stream, over all its batches, what it gives for the table,
as long as no row comes later than the watermark allows. State is kept in Structured Streaming's own store and goes
once the watermark has passed it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import TableStore


def _timed(events: DataFrame, late: str) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if rows.isStreaming else rows


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "2 days") -> DataFrame:
    """One row for each key; repeats must be equal, as which of them comes first is chance."""
    rows = _timed(events, late)
    return rows.dropDuplicatesWithinWatermark([key]) if rows.isStreaming else rows.dropDuplicates([key])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days", by: str = "user_id") -> DataFrame:
    """Events of a user that follow one another within the gap: start, end (of the last event), count and total."""
    grouped = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), by)
    total = F.round(F.sum(F.col("value").cast("decimal(18,4)")), 2).cast("double").alias("total")
    return grouped.agg(F.max("ts").alias("ended_at"), F.count("*").alias("events"), total).select(by, F.col("w.start").alias("started_at"), "ended_at", "events", "total")


def followed_by(first: DataFrame, then: DataFrame, within: str = "1 hour", late: str = "2 days", by: str = "user_id") -> DataFrame:
    """Pairs of events of a user, the second up to ``within`` after the first."""
    one = _timed(first, late).select(F.col(by), F.col("event_id").alias("first_id"), F.col("ts").alias("first_at"))
    two = _timed(then, late).select(F.col(by).alias("__by"), F.col("event_id").alias("then_id"), F.col("ts").alias("then_at"))
    near = (F.col("then_at") >= F.col("first_at")) & (F.col("then_at") <= F.col("first_at") + F.expr(f"INTERVAL {within}"))
    return one.join(two, (F.col(by) == F.col("__by")) & near).drop("__by")


def keep(stream: DataFrame, store: TableStore, table: str, checkpoint: str) -> None:
    """Appends what the stream gives out, over the batches that are there; a batch that is repeated after a failure is not
    appended again, as its number is part of its commit."""

    def write(batch: DataFrame, number: int) -> None:
        last = store.last_metrics(table, lambda m: m.get("batch", "").rpartition("#")[0] == checkpoint) if store.exists(table) else None
        if last is None or number > int(last["batch"].rpartition("#")[2]):
            store.append(table, batch, metrics={"batch": f"{checkpoint}#{number}"})

    stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replayed(store: TableStore, events: DataFrame, make: Callable[[DataFrame], DataFrame], table: str, files: int, closing: DataFrame) -> DataFrame:
    """What a stream over the events gives, in as many batches as files; ``closing`` rows come last, in two batches of their
    own, to carry the watermark past everything before them."""
    spark, inbox, checkpoint = store.spark, f"{store.root}/inbox-{table}", f"{store.root}/checkpoint-{table}"
    for rows, n in ((events, files), (closing, 1), (closing, 1)):
        rows.repartition(n).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        keep(make(stream), store, table, checkpoint)
    return store.read(table)
