"""Sharding along a Hilbert curve.

Several metadata columns are quantised to BITS bits each by their own quantiles, a row's cells give
its index on the Hilbert curve, rows are ordered by (index, doc_id), and the order is cut into runs
whose row counts are at most one apart. Rows near on the curve are near in every column, so a run
spans few values of each and readers skip most runs whichever column they filter by.

Quantiles are of whole values: numbers as they are (whole numbers as longs, others as doubles), text by its
UTF-8 bytes, however long. Text is counted by value, the distinct values are sorted by ranges, and only the
values at the cuts, fewer than 2 ** BITS, come to the driver.

The order is found in two steps, so that no task sees all rows: rows are dealt by ranges of the whole
key (a hot cell is cut by doc_id) and sorted there; then each range's size gives its offset.

``write_shards`` writes the rows so ordered, a folder for each shard, with a table of every shard's rows,
bytes and least and greatest value of each dimension; ``read_shards`` reads no shard that it rules out.

Defined results: null values of a metadata column sort first, NaN last; a null text has size 1 and the
checksum of the empty text; rows without doc_id come first within a cell; ties of doc_id are ordered by
checksum and size, and equal rows, in any order, have a slot each; texts of any length are taken whole; an
empty table gives no rows (and an empty table of shards). Other columns are ignored, or carried along.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_columns, materialize, prepare

BITS, SHARDS = 6, 16
DIMENSIONS = ("lang", "source", "n_chars")


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points (rows) with ``bits`` bits in each dimension, after
    J. Skilling, "Programming the Hilbert curve" (2004)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where(x[-1] & q, q - 1, 0)
    x ^= turn
    index = np.zeros_like(turn)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            index = index << 1 | x[i] >> b & 1
    return index


def dimension(docs: DataFrame, name: str) -> Column:
    """A column as what it is ordered by: a long, a double, or UTF-8 bytes."""
    kind = docs.schema[name].dataType
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return docs[name].cast("long")
    if isinstance(kind, (T.NumericType, T.TimestampType)):
        return docs[name].cast("double")
    return docs[name].cast("string").cast("binary")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of the partition and each row's place there."""
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], names=[*batch.schema.names, "part", "local"])
        at += n


def _offsets(sizes: dict[int, int]) -> list[tuple[int, int]]:
    out, before = [], 0
    for p in sorted(sizes):
        out.append((p, before))
        before += sizes[p]
    return out


def text_edges(values: DataFrame, cells: int) -> list[bytes]:
    """The last value of each of ``cells`` equal parts of the column ``value`` (binary) but the last; a
    common value ends several."""
    spark = values.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = values.where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    dealt = counted.repartitionByRange(parts, "value").withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "values")
    sizes = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one number a partition
    total = sum(sizes.values())
    if not total:
        return []
    starts = dict(_offsets(sizes))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            found = []
            for value, n, part in zip(*(c.to_pylist() for c in batch.columns)):
                if at is None or part != at[0]:
                    at = (part, starts[part])
                after = at[1] + n
                if after < total:
                    found += [value] * (after * cells // total - at[1] * cells // total)
                at = (part, after)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["value"])

    ordered = dealt.repartition(parts, "part").sortWithinPartitions("part", "value")
    return sorted(r[0] for r in ordered.select("value", "n", "part").mapInArrow(step, "value binary").collect())  # fewer than ``cells``


def edges_of(docs: DataFrame, dimensions: Sequence[str], bits: int) -> list:
    """For each dimension the sorted values that part its cells: a value's cell is how many are less, so
    that columns of few values spread over all cells too."""
    columns = {d: dimension(docs, d) for d in dimensions}
    kinds = {d: docs.select(c.alias("c")).schema["c"].dataType for d, c in columns.items()}
    numbers = [d for d in dimensions if not isinstance(kinds[d], T.BinaryType)]
    steps = F.array(*[F.lit(i / (1 << bits)) for i in range(1, 1 << bits)])
    found = {}
    if numbers:
        row = docs.select(*(columns[d].alias(f"d{i}") for i, d in enumerate(numbers))).agg(*(F.percentile_approx(f"d{i}", steps, F.lit(10_000)).alias(f"d{i}") for i in range(len(numbers)))).first()
        for i, d in enumerate(numbers):
            found[d] = np.sort(np.array(row[i] or [], np.float64 if isinstance(kinds[d], T.DoubleType) else np.int64))
    for d in dimensions:
        if d not in found:
            found[d] = text_edges(docs.select(columns[d].alias("value")), 1 << bits)
    return [found[d] for d in dimensions]


def cells_of(column: pa.Array, edges) -> np.ndarray:
    """The cell of each value; null is in the first."""
    if isinstance(edges, np.ndarray):
        values = column.fill_null(0).to_numpy(zero_copy_only=False)
        return np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(edges, values, side="left"))
    coded = column.dictionary_encode()
    own = np.array([bisect_left(edges, v) for v in coded.dictionary.to_pylist()] + [0], np.int64)
    return own[coded.indices.fill_null(len(own) - 1).to_numpy(zero_copy_only=False)]


def assign(docs: DataFrame, dimensions: Sequence[str] = DIMENSIONS, shards: int = SHARDS, bits: int = BITS, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, curve (the index), the cell of each dimension, shard and slot; with
    ``carry`` the whole row too, as struct ``row``."""
    spark = docs.sparkSession
    prepare(spark)
    edges = edges_of(docs, dimensions, bits)
    columns = [dimension(docs, d).alias(f"d{i}") for i, d in enumerate(dimensions)]
    n = len(columns)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [raw or b"" for raw in batch.column(1).to_pylist()]
            cells = [cells_of(c, e) for c, e in zip(batch.columns[2 : 2 + n], edges)]
            curve = curve_index(np.stack(cells, axis=1), bits)
            arrays = [batch.column(0), pa.array([len(r) + 1 for r in raws], pa.int64()), pa.array([zlib.crc32(r) for r in raws], pa.int64()), pa.array(curve), *(pa.array(c.astype(np.int32)) for c in cells), *batch.columns[2 + n :]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "size", "text_crc32", "curve", *(f"cell{i}" for i in range(n)), *["row"] * carry])

    whole = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] * carry
    own = doc_columns(docs, *columns, *whole)
    schema = T.StructType.fromDDL("doc_id long, size long, text_crc32 long, curve long" + "".join(f", cell{i} int" for i in range(n)))
    for f in own.schema.fields[2 + n :]:
        schema = schema.add(f)
    rows = own.mapInArrow(step, schema)
    rows = rows if carry else materialize(rows, "cells")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = ["curve", "doc_id", "text_crc32", "size"]
    dealt = rows.repartitionByRange(parts, *key).sortWithinPartitions(*key)
    ordered = materialize(dealt.mapInArrow(_numbered, schema.add("part", T.IntegerType()).add("local", T.LongType())), "ordered")
    sizes = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one number a partition
    total = sum(sizes.values())
    starts = spark.createDataFrame(_offsets(sizes), "part int, before long")
    place = F.col("before") + F.col("local")
    shard = F.expr(f"(before + local) * {shards} div {max(total, 1)}").cast("int")
    found = ordered.join(F.broadcast(starts), "part").withColumns({"shard": shard, "place": place})
    first = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return found.withColumn("slot", F.col("place") - first).drop("part", "local", "before", "place")


def run_statistics(assigned: DataFrame, dimensions: int = len(DIMENSIONS)) -> DataFrame:
    """Each run's rows and bytes, and its least and greatest cell of every dimension."""
    spans = [f(f"cell{i}").alias(f"{name}{i}") for i in range(dimensions) for f, name in ((F.min, "low"), (F.max, "high"))]
    return assigned.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *spans)


def write_shards(docs: DataFrame, path: str, dimensions: Sequence[str] = DIMENSIONS, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Writes all rows, with all columns and their slot, to ``path``/shards, a folder a shard, and what a
    reader prunes by to ``path``/statistics: shard, rows, bytes, and low and high (structs, by dimension)."""
    found = assign(docs, dimensions, shards, bits, carry=True)
    found.select(F.struct("row.*").alias("row"), "size", "slot", "shard").write.partitionBy("shard").parquet(f"{path}/shards")
    spans = [F.struct(*(f(f"row.{d}").alias(d) for d in dimensions)).alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]
    docs.limit(0).coalesce(1).write.parquet(f"{path}/schema")  # a table without rows has no shards to tell it
    whole = _written(docs.sparkSession, path)
    whole.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *spans).coalesce(1).write.parquet(f"{path}/statistics")  # a row a shard
    return docs.sparkSession.read.parquet(f"{path}/statistics")


def _written(spark: SparkSession, path: str) -> DataFrame:
    row = spark.read.parquet(f"{path}/schema").schema
    return spark.read.schema(T.StructType([T.StructField("row", row)]).add("size", T.LongType()).add("slot", T.LongType()).add("shard", T.IntegerType())).parquet(f"{path}/shards")


def read_shards(spark: SparkSession, path: str, bounds: dict[str, tuple]) -> DataFrame:
    """The written rows within ``bounds`` (dimension: least and greatest value), from no shard whose
    statistics rule them out, with their own columns."""
    wide = F.lit(True)
    for d, (low, high) in bounds.items():
        wide &= (F.col(f"low.{d}") <= high) & (F.col(f"high.{d}") >= low)
    shards = [r["shard"] for r in spark.read.parquet(f"{path}/statistics").where(wide).select("shard").collect()]  # a number a shard
    whole = _written(spark, path).where(F.col("shard").isin(*shards))
    for d, (low, high) in bounds.items():
        whole = whole.where(F.col(f"row.{d}").between(low, high))
    return whole.select("row.*")
