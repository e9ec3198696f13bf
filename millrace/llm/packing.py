"""Best-fit packing by large-item matching.

Every document becomes its token ids and one end id; longer ones than CAPACITY are cut into whole
sequences, the first piece taking what is left over. Pieces of more than a third of the capacity
are *large*: no sequence holds three, so they are matched in pairs, the largest first, each with
the largest partner that still fits. The smaller pieces then fill the remaining gaps from the
largest on, each into the smallest gap that holds it, and open new sequences where none does.

The plan depends on nothing but how many pieces there are of each length, a histogram of at most
CAPACITY rows however many documents there are. It is made on the driver for whole groups of equal
sequences: one record says "pieces number r to r+k of length s go to sequences b to b+k at offset
o". A record uses up a group or a length, so their number depends on the capacity only. Each piece
then meets its record in a join by its length and its number among the pieces of that length. The task that cuts a document counts
its own pieces of each length, and offsets by (length, task) make that a number over all: no length, and
no document id, is gathered in one task, and pieces move for nothing but the join with those offsets.

Defined results: a null or empty text is its end id alone; repeated rows, and rows without doc_id, are packed
each; a text of any length is cut into whole sequences and its first piece; which of two pieces of equal
length goes first is left open; an empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import doc_columns, materialize
from .tokens import ByteTokens

CAPACITY, END = 2048, 0
#: Offsets that are broadcast at most (some 40 MB); more are joined by shuffling.
BROADCAST_OFFSETS = 500_000
#: Rows that Spark's Parquet reader holds at a time: those of texts and of ids are long (its default is 4096).
READER_ROWS = 512


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; the first may be shorter."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, with_ids: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part (the task's number), rank (the piece's, from 0, among
    the task's pieces of its length) and, if wanted, the ids (little-endian, 32 bits)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, part, seen = ByteTokens.load(tokenizer), TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = END.to_bytes(4, "little")
        for batch in batches:
            doc, number, start, length, crc, rank, kept = [], [], [], [], [], [], []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokens.encode([raw.as_py()])[0] + end
                view = memoryview(ids)
                for k, (at, n) in enumerate(cut(len(ids) // 4, capacity)):
                    own = view[4 * at : 4 * (at + n)]
                    doc.append(doc_id)
                    number.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(own))
                    rank.append(seen[n])
                    seen[n] += 1
                    if with_ids:
                        kept.append(bytes(own))
            arrays = [pa.array(doc, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(doc), pa.int32()), pa.array(rank, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(kept, pa.binary())] * with_ids, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"] + ["ids"] * with_ids)

    return doc_columns(docs).mapInArrow(step, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids binary" * with_ids)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, count, first sequence, offset): where each length's pieces go."""
    left = {s: n for s, n in histogram.items() if n}
    used = dict.fromkeys(left, 0)  # pieces of a length that have a place
    records: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int, int]]] = {}  # gap: (first sequence, count, fill) of its groups
    sequences = 0

    def put(s: int, count: int, first: int, offset: int) -> None:
        records.append((s, used[s], count, first, offset))
        used[s] += count
        left[s] -= count

    def open_gap(first: int, count: int, fill: int) -> None:
        if fill < capacity:
            gaps.setdefault(capacity - fill, []).append((first, count, fill))

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for s in large:
        while left[s]:
            partner = next((t for t in large if t <= min(s, capacity - s) and left[t] > (t == s)), None)
            if partner is None:
                count = left[s]
                put(s, count, sequences, 0)
                open_gap(sequences, count, s)
            elif partner == s:
                count = left[s] // 2
                put(s, count, sequences, 0)
                put(s, count, sequences, s)
                open_gap(sequences, count, 2 * s)
            else:
                count = min(left[s], left[partner])
                put(s, count, sequences, 0)
                put(partner, count, sequences, s)
                open_gap(sequences, count, s + partner)
            sequences += count
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            best = min((g for g in gaps if g >= s), default=None)
            if best is None:  # new sequences, each with as many of this length as it holds
                each = capacity // s
                count = max(1, left[s] // each)
                first, sequences = sequences, sequences + count
                for k in range(min(each, left[s])):
                    put(s, count, first, k * s)
                    fill = (k + 1) * s
                open_gap(first, count, fill)
                continue
            first, count, fill = gaps[best].pop()
            if not gaps[best]:
                del gaps[best]
            if count > left[s]:
                gaps.setdefault(best, []).append((first + left[s], count - left[s], fill))
                count = left[s]
            put(s, count, first, fill)
            open_gap(first, count, fill + s)
    return records


def numbered(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds ``number``, gapless from 0 among the pieces of a length. ``sizes``: length, part and count."""
    before = F.sum("count").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    if sizes.count() <= BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    return found.join(offsets, ["length", "part"]).withColumn("number", F.col("before") + F.col("rank")).drop("part", "rank", "before")


def pack(docs: DataFrame, tokenizer: str, with_ids: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with their sequence_id and the offset there."""
    spark: SparkSession = docs.sparkSession
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS)
    found = materialize(pieces(docs, tokenizer, with_ids, capacity), "pieces")
    sizes = materialize(found.groupBy("length", "part").count(), "sizes")  # capacity rows a task at most
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    records = sorted(plan(histogram, capacity))
    places = F.broadcast(spark.createDataFrame(records, "of long, first long, n long, sequence long, offset long"))  # bounded by the capacity
    found = numbered(found, sizes)
    own = (F.col("length") == F.col("of")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("first") + F.col("n"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return found.join(places, own).select(*names, (F.col("sequence") + F.col("number") - F.col("first")).alias("sequence_id"), "offset")
