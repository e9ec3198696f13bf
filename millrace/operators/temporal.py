"""Joins by time: the latest earlier row of a key, and rows of a key within an interval.

Both sides are dealt by key and time bucket, so a hot key is as many tasks as it has buckets and no join is a nested
loop. What crosses a bucket's edge is repeated: for the as-of join one row for each key and bucket, for the interval
join the rows near an edge. Times are seconds or anything that casts to a timestamp; rows without key or time match nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _micros(time: str) -> Column:
    return F.unix_micros(F.col(f"`{time}`").cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, on: str, time: str, columns: Sequence[str], right_time: str | None = None, bucket_seconds: int = 86400) -> DataFrame:
    """Every left row with ``columns`` of the right row of its key that is the latest not after it; of right rows at one
    time the one with the greatest columns, in their order; null where there is none.

    Within a bucket the last right row is found by a window. What a bucket inherits is the last right row of the buckets
    before it: those are first reduced to a row for each key and bucket, over which alone a window goes by key."""
    right_time, width = right_time or time, bucket_seconds * 1_000_000
    own = right.select(F.col(f"`{on}`").alias("k"), _micros(right_time).alias("t"), *(F.col(f"`{c}`") for c in columns)).where("k IS NOT NULL AND t IS NOT NULL")
    own = own.select("k", "t", F.floor(F.col("t") / width).alias("b"), F.struct("t", *columns).alias("r"))
    rows = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("l"), F.col(f"`{on}`").alias("k"), _micros(time).alias("t")).withColumn("b", F.floor(F.col("t") / width))
    none_l, none_r = (F.lit(None).cast(df.schema[c].dataType).alias(c) for df, c in ((rows, "l"), (own, "r")))
    buckets = rows.where("k IS NOT NULL").select("k", "b").distinct().withColumn("r", none_r).unionByName(own.groupBy("k", "b").agg(F.max("r").alias("r")))
    summary = buckets.groupBy("k", "b").agg(F.max("r").alias("r"))
    before = F.last("r", ignorenulls=True).over(W.partitionBy("k").orderBy("b").rowsBetween(W.unboundedPreceding, -1))
    carried = summary.select("k", "b", before.alias("r")).where("r IS NOT NULL")
    placed = carried.select("k", F.col("r.t").alias("t"), "b", none_l, "r").unionByName(own.select("k", "t", "b", none_l, "r"))
    line = placed.withColumn("side", F.lit(0)).unionByName(rows.select("k", "t", "b", "l", none_r).where("k IS NOT NULL AND t IS NOT NULL").withColumn("side", F.lit(1)))
    upto = W.partitionBy("k", "b").orderBy("t", "side", "r").rowsBetween(W.unboundedPreceding, 0)
    met = line.withColumn("found", F.last("r", ignorenulls=True).over(upto)).where("side = 1").select("l", "found")
    lost = rows.where("k IS NULL OR t IS NULL").select("l", none_r).withColumnRenamed("r", "found")
    return met.unionByName(lost).select("l.*", *(F.col(f"found.`{c}`").alias(f"{c}_before" if c in left.columns else c) for c in columns))


def interval_join(left: DataFrame, right: DataFrame, on: str, time: str, right_time: str, before_seconds: int, after_seconds: int) -> DataFrame:
    """Pairs of rows of one key (kept from the left) whose right time lies from ``before_seconds`` before the left one to
    ``after_seconds`` after it. A left row is in the bucket of its time, a right row in all buckets whose left rows it may
    meet, two mostly; so each pair meets once, in an equi-join by key and bucket. Other columns must differ in name."""
    before, after = before_seconds * 1_000_000, after_seconds * 1_000_000
    width = max(before + after, 1)
    one = left.withColumn("__l", _micros(time)).withColumn("__b", F.floor(F.col("__l") / width))
    span = F.sequence(F.floor((F.col("__r") - after) / width), F.floor((F.col("__r") + before) / width))
    other = right.withColumnRenamed(on, "__k").withColumn("__r", _micros(right_time)).where("__r IS NOT NULL").withColumn("__rb", F.explode(span))
    near = F.col("__r").between(F.col("__l") - before, F.col("__l") + after)
    return one.join(other, (F.col(on) == F.col("__k")) & (F.col("__b") == F.col("__rb")) & near).drop("__l", "__b", "__k", "__r", "__rb")
