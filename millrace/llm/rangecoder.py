"""Token ids in a compressed file format: context mixing drives a range coder, block by block.

Ids are cut into blocks of BLOCK to twice as many. Every block starts from the same state and carries
checksums, so any block can be read, or found damaged, without the others. A block is dealt into lanes,
contiguous stretches of equal length that are coded in step, one NumPy element each; all lanes share the
block's model, which learns after every step what all of them have seen. Reader and writer do the same
whole-number arithmetic, so they agree on any machine.

The probability of an id is a sum over three orders, p(x) = w2 * p2(x) + w1 * p1(x) + w0 * p0(x):

* order 2 remembers the id that followed the same two ids last time, and how often in a row that came
  true; p2 is all on that id. Entries hold the two ids themselves, so a context is never mistaken;
* order 1 does the same for the id before, and has an entry for each id;
* order 0 counts all ids of the block, from a fixed slant towards low ones (the tokenizer's earlier
  merges), and every id has a count;
* the weights are learnt in the block, for each pair of confidences and for guesses that agree: an order's
  weight is the share of the ids that it has accounted for so far. An id that two orders foresee is
  credited to both by their part in the sum.

The guessed ids take their whole sums at the start of the range, and order 0 without them, which nothing
else foresees, takes the rest: no part of the range is spent on an id that is also found elsewhere.
The coder has 64 bits of state and gives out 32 at a time; a carry runs back into units given before.
Lanes' units are stored in the order in which the reader asks for them.

A segment (the payload of one row of the written table) is: magic, then for each document its id and
length, then each block's number of ids, bytes and CRC-32 of its bytes and of its ids, then the blocks.
Documents don't cross segments. Rows hold (bucket, segment, n_ids, file); bucket and segment ascend with doc_id.

Defined results: a null or empty text is its end id alone; rows without doc_id come first; repeated
rows are all written, in any order among themselves, and a doc_id that many rows share is cut into
buckets like any other stretch; a very long text has several blocks of its segment to itself; ids that
don't lie below IDS are refused; other columns are ignored; an empty table has no files and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import doc_columns, materialize
from .tokens import WordTokens

END, BLOCK, LANES = 2, 1 << 21, 8192
MAGIC = b"MRIDS02\n"
#: Ids lie below this.
IDS = 1 << 16
#: Entries of order 2, the highest confidence, what an id adds to its count, the sum at which counts are
#: halved, and the steps after which a grown block sums up anew.
_SLOTS, _SURE, _STEP, _LIMIT, _PACE = 1 << 18, 15, 64, 1 << 22, 16
#: Weights are 65536ths: order 0 keeps _LEAST of them at least, and an order with a guess _LIVE.
_LEAST, _LIVE = 512, 16
_SIDE = _SURE + 1
_NO_ID = np.int32(IDS)
#: Confidence after a wrong and after a right guess: half of it, or one more.
_NEXT = np.array([max(s >> 1, 1) for s in range(_SIDE)] + [min(s + 1, _SURE) for s in range(_SIDE)], np.int32)
_U16, _U32, _SMALL = np.uint64(16), np.uint64(32), np.uint64(1 << 32)


class _Mixer:
    """A block's model: ``look`` forecasts for the first n lanes, ``learn`` takes in what came there."""

    def __init__(self, lanes: int):
        self.counts = np.zeros(IDS + 1, np.int32)  # one more, always zero: the id of no guess
        self.counts[:IDS] = 1 + 30_000 // (np.arange(IDS) + 60)
        self.cum = np.zeros(IDS + 2, np.int32)
        self.memory2 = np.zeros(_SLOTS, np.int64)  # both ids, guess and confidence: 32, 16 and 4 bits
        self.memory1 = np.zeros(IDS, np.int32)  # guess and confidence
        # what orders 2, 1 and 0 have accounted for, by class: confidence of 2 and of 1, agreement
        grade = np.arange(_SIDE) * 64
        credit = np.full((3, _SIDE, _SIDE, 2), 256)
        credit[0], credit[1] = 2 * grade[:, None, None], grade[:, None]
        self.credit = credit.reshape(3, -1)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.steps, self.due, self.held, self.weighed = 0, 0, [], []
        self.first_id = None
        self._renew()

    def _renew(self) -> None:
        """Counts and weights take in the steps held back."""
        if self.held:
            self.counts += (_STEP * np.bincount(np.concatenate(self.held), minlength=IDS + 1)).astype(np.int32)
            self.held = []
        if self.weighed:
            kind, r2, r1 = map(np.concatenate, zip(*self.weighed))
            self.weighed = []
            classes = self.credit.shape[1]
            two, one = (np.bincount(kind, weights=r, minlength=classes).astype(np.int64) for r in (r2, r1))
            self.credit += np.stack([two, one, 256 * np.bincount(kind, minlength=classes) - two - one])
            self.credit[:, self.credit.sum(0) > 1 << 22] >>= 1
        while self.counts.sum() > _LIMIT:
            self.counts[:IDS] = (self.counts[:IDS] + 1) >> 1
        np.cumsum(self.counts, out=self.cum[1:])
        self.total, self.first_id = int(self.cum[IDS]), None
        self.share = ((self.counts.astype(np.int64) << 15) // self.total).astype(np.int32)  # in 32768ths
        w = self.credit[:2] * (65536 - _LEAST - 2 * _LIVE) // np.maximum(self.credit.sum(0), 1)
        live = np.arange(_SIDE) > 0
        w = w.reshape(2, _SIDE, _SIDE, 2) + _LIVE
        w[0] *= live[:, None, None]
        w[1] *= live[:, None]
        self.weight2, self.weight1 = w.reshape(2, -1).astype(np.int32)
        self.weight0 = 65536 - self.weight2 - self.weight1

    def look(self, n: int) -> None:
        """Ids a and b that orders 2 and 1 foresee (IDS: none; if they agree, a alone), and their
        probabilities as sums over the orders, in 65536ths."""
        last = self.last[:n]
        self.key = self.before[:n] << 16 | last
        self.at2 = (self.key * 2654435761 >> 24) & (_SLOTS - 1)
        e2, e1 = self.memory2.take(self.at2), self.memory1.take(last)
        low = e2.astype(np.int32) & 0xFFFFF
        self.s2, self.g2 = (low & 15) * (e2 >> 20 == self.key), low >> 4  # another context's entry counts as none
        self.s1, self.g1 = e1 & 15, e1 >> 4
        some2, some1 = self.s2 > 0, self.s1 > 0
        self.agree = agree = (self.g2 == self.g1) & some2 & some1
        self.kind = (self.s2 << 5) + (self.s1 << 1) + agree
        self.w2, self.w1, w0 = self.weight2.take(self.kind), self.weight1.take(self.kind), self.weight0.take(self.kind)
        self.a, self.b = np.where(some2, self.g2, _NO_ID), np.where(some1 & ~agree, self.g1, _NO_ID)
        self.p_a = self.w2 + self.w1 * agree + (w0 * self.share.take(self.a) >> 15)
        self.p_b = self.w1 * ~agree + (w0 * self.share.take(self.b) >> 15)

    def learn(self, x: np.ndarray, first: np.ndarray, second: np.ndarray, n: int) -> None:
        """Takes in ids x; ``first`` are those that were a, ``second`` those that were b. Weights are
        learnt from every step of a young block, later from every fourth."""
        self.held.append(x)
        if self.steps < 32 or not self.steps & 3:
            r2 = (self.w2 << 8) // np.maximum(self.p_a, 1) * first
            r1 = (self.w1 << 8) // np.maximum(np.where(first, self.p_a, self.p_b), 1) * (second | first & self.agree)
            self.weighed.append((self.kind, r2, r1))
        last = self.last[:n]
        self.memory2[self.at2] = self.key << 20 | _after(self.g2, self.s2, x)
        self.memory1[last] = _after(self.g1, self.s1, x)
        self.before[:n] = last
        self.last[:n] = x
        self.steps += 1
        if self.steps > self.due:
            self.due = self.steps + min(_PACE, self.steps // 3)
            self._renew()

    def without(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, count_a: np.ndarray, count_b: np.ndarray) -> np.ndarray:
        """Where ids x begin in order 0 if a and b are left out."""
        return (self.cum.take(x) - count_a * (a < x) - count_b * (b < x)).astype(np.uint64)

    def left(self, own: np.ndarray) -> tuple[np.ndarray, ...]:
        """For some lanes, the guesses, their counts, and the sum of all other counts."""
        a, b = self.a.take(own), self.b.take(own)
        count_a, count_b = self.counts.take(a), self.counts.take(b)
        return a, b, count_a, count_b, (self.total - count_a - count_b).astype(np.uint64)

    def holding(self, f: np.ndarray) -> np.ndarray:
        """The ids whose ranges in order 0 hold f."""
        if self.first_id is None:  # the id at every 64th place, which is mostly the id at the next 63 as well
            self.first_id = np.cumsum(np.bincount((self.cum[1 : IDS + 1] + 63) >> 6), dtype=np.int32)
        x = self.first_id.take(f >> 6)
        at = np.flatnonzero(self.cum.take(x + 1) <= f)
        x[at] = np.searchsorted(self.cum, f[at], "right") - 1
        return x


def _after(guess: np.ndarray, sure: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A memory's entry once x has come: a wrong guess of confidence 1 gives way."""
    return np.where(sure > 1, guess, x) << 4 | _NEXT.take((guess == x) * _SIDE + sure)


def _shape(size: int) -> tuple[int, int, int]:
    """Lanes and steps of a block, and the length of its last lane."""
    steps = -(-size // min(LANES, -(-size // 64)))
    lanes = -(-size // steps)
    return lanes, steps, size - (lanes - 1) * steps


def encode_block(block: np.ndarray) -> bytes:
    if not len(block):
        return b""
    if block.max() >= IDS:
        raise ValueError(f"ids must be below {IDS}")
    lanes, steps, tail = _shape(len(block))
    ids = np.zeros(lanes * steps, np.int32)
    ids[: len(block)] = block
    ids = np.ascontiguousarray(ids.reshape(lanes, steps).T)
    m = _Mixer(lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    units, used = np.zeros((steps + 3, lanes), np.uint64), np.zeros(lanes, np.int64)
    flat, asked = units.ravel(), []
    one = np.uint64(1)
    for t in range(steps):
        n = lanes - (t >= tail)
        x = ids[t, :n]
        m.look(n)
        first, second = x == m.a, x == m.b
        unit = span[:n] >> _U16
        start = unit * np.where(first, 0, np.where(second, m.p_a, m.p_a + m.p_b)).astype(np.uint64)
        width = unit * np.where(first, m.p_a, m.p_b).astype(np.uint64)
        own = np.flatnonzero(~(first | second))
        y, (a, b, count_a, count_b, total) = x[own], m.left(own)
        part = (span[own] - start[own]) // total
        start[own] += part * m.without(y, a, b, count_a, count_b)
        width[own] = part * m.counts.take(y).astype(np.uint64)
        l = low[:n]
        l += start
        carry = np.flatnonzero(l < start)
        flat[(used[carry] - 1) * lanes + carry] += one
        span[:n] = width
        at = np.flatnonzero(width < _SMALL)
        if len(at):
            k, l = used[at], low[at]
            flat[k * lanes + at] = l >> _U32
            low[at], span[at] = l << _U32, width[at] << _U32
            asked.append((k + 2) * lanes + at)  # the reader is two units ahead
            used[at] = k + 1
        m.learn(x, first, second, n)
    end = low + (_SMALL - one)
    carry = np.flatnonzero(end < low)
    flat[(used[carry] - 1) * lanes + carry] += one
    flat[used * lanes + np.arange(lanes)] = end >> _U32
    for k in range(steps + 2, 0, -1):
        units[k - 1] += units[k] >> _U32
    return np.concatenate([flat[: 2 * lanes], *(flat[k] for k in asked)]).astype("<u4").tobytes()


def decode_block(data: bytes, size: int) -> np.ndarray:
    if not size:
        return np.zeros(0, np.int32)
    lanes, steps, tail = _shape(size)
    units = np.frombuffer(data, "<u4").astype(np.uint64)
    ids = np.zeros((steps, lanes), np.int32)
    m = _Mixer(lanes)
    span = np.full(lanes, 2**64 - 1, np.uint64)
    code, place = units[:lanes] << _U32 | units[lanes : 2 * lanes], 2 * lanes
    one = np.uint64(1)
    for t in range(steps):
        n = lanes - (t >= tail)
        m.look(n)
        c, unit = code[:n], span[:n] >> _U16
        top, both = unit * m.p_a.astype(np.uint64), unit * (m.p_a + m.p_b).astype(np.uint64)
        first, other = c < top, c >= both
        x = np.where(first, m.a, m.b)
        start = np.where(first, 0, np.where(other, both, top))
        width = np.where(first, top, both - top)
        own = np.flatnonzero(other)
        a, b, count_a, count_b, total = m.left(own)
        from_here = start[own]
        part = (span[own] - from_here) // total
        f = np.minimum((c[own] - from_here) // part, total - one).astype(np.int32)
        swap = b < a  # put the guesses back, the lower one first
        f += np.where(swap, count_b, count_a) * (m.cum.take(np.minimum(a, b)) <= f)
        f += np.where(swap, count_a, count_b) * (m.cum.take(np.maximum(a, b)) <= f)
        y = m.holding(f)
        start[own] = from_here + part * m.without(y, a, b, count_a, count_b)
        width[own] = part * m.counts.take(y).astype(np.uint64)
        x[own] = y
        c -= start
        span[:n] = width
        at = np.flatnonzero(width < _SMALL)
        code[at] = code[at] << _U32 | units[place : place + len(at)]
        span[at] = width[at] << _U32
        place += len(at)
        ids[t, :n] = x
        m.learn(x, first, ~(first | other), n)
    return ids.T.ravel()[:size]


def write_segment(doc_ids: list[int | None], documents: list[np.ndarray]) -> bytes:
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint16)
    count = max(1, len(ids) // BLOCK) if len(ids) else 0
    blocks = [ids[len(ids) * k // count : len(ids) * (k + 1) // count] for k in range(count)]
    data = [encode_block(b) for b in blocks]
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    index = zlib.compress(known.tobytes() + np.diff(names, prepend=0).astype("<i8").tobytes() + np.array([len(d) for d in documents], "<i8").tobytes())
    table = b"".join(struct.pack("<IIII", len(b), len(p), zlib.crc32(p), zlib.crc32(b.astype("<u4").tobytes())) for b, p in zip(blocks, data))
    return MAGIC + struct.pack("<III", len(documents), len(blocks), len(index)) + index + table + b"".join(data)


def read_segment(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """The documents of a segment; raises ValueError if a block fails its checksum."""
    if data[:8] != MAGIC:
        raise ValueError("not a segment of token ids")
    n, n_blocks, size = struct.unpack_from("<III", data, 8)
    at = 20 + size
    index = zlib.decompress(data[20:at])
    known = np.frombuffer(index, np.uint8, n)
    names = np.cumsum(np.frombuffer(index, "<i8", n, n))
    lengths = np.frombuffer(index, "<i8", n, n + 8 * n)
    heads = [struct.unpack_from("<IIII", data, at + 16 * k) for k in range(n_blocks)]
    at += 16 * n_blocks
    blocks = []
    for k, (n_ids, length, of_bytes, of_ids) in enumerate(heads):
        payload = data[at : at + length]
        at += length
        if zlib.crc32(payload) != of_bytes:
            raise ValueError(f"block {k} is damaged")
        blocks.append(decode_block(payload, n_ids).astype("<u4"))
        if zlib.crc32(blocks[-1].tobytes()) != of_ids:
            raise ValueError(f"block {k} doesn't hold the ids it was written from")
    ids = np.concatenate(blocks) if blocks else np.zeros(0, "<u4")
    cuts = np.cumsum(lengths)
    return [int(x) if k else None for x, k in zip(names, known)], [ids[b - s : b] for b, s in zip(cuts, lengths)]


_NONE = -(1 << 63)


def encode_ids(docs: DataFrame, tokenizer: str, bounds: list[int]) -> DataFrame:
    """bucket, doc_id and the ids (16 bits each) with the end id. Buckets are ranges of doc_id, cut at
    ``bounds``; a doc_id that is there several times has as many buckets, and its rows are dealt in turn."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens.load(tokenizer)
        edges, end, row = np.array(bounds, np.int64), np.array([END], "<u2").tobytes(), 0
        for batch in batches:
            ids = [x + end for x in tokens.encode(batch.column(1).to_pylist())]
            names = batch.column(0).fill_null(_NONE).to_numpy()
            bucket, over = np.searchsorted(edges, names, side="left"), np.searchsorted(edges, names, side="right")
            bucket += np.arange(row, row + len(ids)) % np.maximum(over - bucket, 1)
            row += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), batch.column(0), pa.array(ids, pa.binary())], names=["bucket", "doc_id", "ids"])

    return doc_columns(docs).mapInArrow(step, "bucket int, doc_id long, ids binary")


def write_ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The table of segments, written to the shared folder in ascending order of doc_id."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = F.coalesce(docs["doc_id"].cast("long"), F.lit(_NONE))
    shares = F.percentile_approx(name, F.array(*[F.lit((i + 1) / parts) for i in range(parts - 1)]), F.lit(100 * parts)) if parts > 1 else F.array().cast("array<long>")
    bounds = sorted(docs.select(shares).first()[0] or [])  # one number for each partition

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, documents, size, bucket, segment = [], [], 0, None, 0

        def out() -> pa.RecordBatch:
            arrays = [pa.array([bucket], pa.int32()), pa.array([segment], pa.int32()), pa.array([size], pa.int64()), pa.array([write_segment(names, documents)], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["bucket", "segment", "n_ids", "file"])

        for batch in batches:
            for own, name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if names and (own != bucket or size >= BLOCK):
                    yield out()
                    segment = segment + 1 if own == bucket else 0
                    names, documents, size = [], [], 0
                bucket = own
                names.append(name)
                documents.append(np.frombuffer(raw, "<u2"))
                size += len(documents[-1])
        if names:
            yield out()

    dealt = encode_ids(docs, tokenizer, bounds).repartitionById(parts, "bucket").sortWithinPartitions("bucket", "doc_id")
    return materialize(dealt.mapInArrow(step, "bucket int, segment int, n_ids long, file binary"), "ids")


def read_ids(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, the ids."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, segment, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                names, documents = read_segment(data)
                n = len(names)
                sizes = np.array([len(d) for d in documents], np.int64)
                raws = [d.tobytes() for d in documents]
                arrays = [pa.array(np.full(n, bucket, np.int32)), pa.array(np.full(n, segment, np.int32)), pa.array(names, pa.int64()), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes), pa.array([zlib.crc32(r) for r in raws], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(raws, pa.binary())] * with_ids, names=["bucket", "segment", "doc_id", "local", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    sizes = files.select("bucket", "segment", "n_ids")
    # one row for each bucket, so one task can add them up
    buckets = sizes.groupBy("bucket").agg(F.sum("n_ids").alias("n")).select("bucket", (F.sum("n").over(W.orderBy("bucket")) - F.col("n")).alias("bucket_start"))
    within = F.sum("n_ids").over(W.partitionBy("bucket").orderBy("segment")) - F.col("n_ids")
    starts = sizes.select("bucket", "segment", within.alias("segment_start")).join(buckets, "bucket")
    found = files.select("bucket", "segment", "file").mapInArrow(step, "bucket int, segment int, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    start = (F.col("bucket_start") + F.col("segment_start") + F.col("local")).cast("long").alias("start")
    return found.join(starts, ["bucket", "segment"]).select("doc_id", start, "n_tokens", "ids_crc32", *["ids"] * with_ids)
