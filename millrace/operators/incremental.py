"""Loading by high-water mark: rows since the mark, less a look-back, are merged by key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import TableStore
from .merge import upsert
from .silver import keep_first

WATERMARKS = "pipeline_id string, source_table string, target_table string, watermark timestamp, rows long, run_id string"


@dataclass(frozen=True)
class Load:
    pipeline_id: str
    target: str
    key: str
    time_column: str
    lookback_hours: float = 24.0
    watermarks: str = "watermarks"


def watermark(store: TableStore, load: Load) -> object | None:
    """The latest mark of a pipeline, or None before its first load."""
    store.ensure(load.watermarks, WATERMARKS)
    return store.read(load.watermarks).where(F.col("pipeline_id") == load.pipeline_id).agg(F.max("watermark")).first()[0]


def batch_since(source: DataFrame, time_column: str, mark: object | None, lookback_hours: float) -> DataFrame:
    """All rows before a first load; then those later than the mark less the look-back. Times count in whole seconds,
    rounded to the nearest (halves to even) as SQL casts do, and not cut off."""
    if mark is None:
        return source
    seconds = lambda c: F.rint(c.cast("timestamp").cast("double")).cast("long")
    return source.where(seconds(F.col(time_column)) > seconds(F.lit(mark)) - int(lookback_hours * 3600))


def run_load(store: TableStore, load: Load, source: DataFrame, run_id: str) -> dict:
    """One load. The merged table's log entry carries the new mark, so a load that fails before the
    mark is written is repeated over the same rows and changes nothing."""
    mark = watermark(store, load)
    batch = batch_since(source, load.time_column, mark, load.lookback_hours)
    stamp = F.col(load.time_column).cast("timestamp")
    counts = batch.agg(F.count("*").alias("rows"), F.max(stamp).alias("top"), F.sum((stamp > F.lit(mark).cast("timestamp")).cast("long") if mark is not None else F.lit(1).cast("long")).alias("fresh")).first()
    if not counts["rows"]:
        return {"rows": 0, "fresh": 0, "watermark": mark}
    own = keep_first(batch, [load.key], [F.col(load.time_column).desc_nulls_last(), F.xxhash64(*batch.columns)])
    new = counts["top"] if mark is None or (counts["top"] is not None and counts["top"] > mark) else mark
    store.merge(load.target, own, [load.key], upsert(), metrics={"run_id": run_id, "watermark": str(new)})
    row = [(load.pipeline_id, "", load.target, new, counts["rows"], run_id)]
    store.append(load.watermarks, store.spark.createDataFrame(row, WATERMARKS))
    return {"rows": counts["rows"], "fresh": counts["fresh"] or 0, "watermark": new}
