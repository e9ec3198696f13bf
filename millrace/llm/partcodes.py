"""Vector codes: every part of a vector as the index of its nearest codebook entry, found in vantage-point trees.

A component x is the integer floor(256 x); a vector is cut into PARTS equal parts, and each part position
has a codebook, which starts as that part of the ENTRIES smallest vec_ids. Each of ROUNDS rounds assigns every
part to its nearest entry (squared Euclidean distance, of equals the lowest index) and replaces entries by
the floor of their parts' mean; an entry without parts stays. Then parts are assigned once more.

Search: each position has a vantage-point tree over its entries. A node holds one entry, its other entries lie
in a near and a far half by their distance to it, and it keeps the greatest distance of the near half rounded
up and the least of the far half rounded down, as integers. All vectors of a batch go down the tree
together: those nearer to the near half see it first. By the triangle inequality a half is
passed over only if even its rounded bound lies beyond the best distance found, rounded up; where it equals the best it
is visited, since an equal distance may belong to a lower index. Distances that decide are whole numbers.

Training sends the codebooks to the tasks (64 KB at 64 components: PARTS * ENTRIES entries, whatever the input), which
send back sums and counts of each entry; Spark adds those up. Nothing else passes the driver. Sums of equal labels are
joined back by broadcast when there are BROADCAST_KEYS labels at most, else by a shuffled join whose
large partitions adaptive execution splits.

Defined results: rows whose vector is null or holds a null, NaN or infinite component are dropped, and so are those of
another length than the row with the smallest vec_id, or of a length that PARTS doesn't divide; a
null vec_id comes last in order; of rows with one vec_id those with the least vector come first. Components beyond
+-2^19 (less in vectors of over 64) count as that, as the sum of squares would not fit a long. With fewer than ENTRIES rows there are as many
entries; repeated rows are each coded; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, broadcast_value, materialize, prepare

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LEAF, ROWS = 6, 8192
#: Sums of squared differences stay below it.
MOST = 1 << 62


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the vector as integers (``v``), of the rows that aren't dropped for their components."""
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    vector = vectors["embedding"]
    limit = F.floor(F.sqrt(F.lit(float(MOST)) / F.greatest(F.size(vector), F.lit(64))) / 2).cast("double")
    x = lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, limit), -limit)).cast("int")
    kept = vectors.where(vector.isNotNull() & ~F.exists(vector, bad))
    return kept.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].alias("label"), F.transform(vector, x).alias("v"))


def root_down(n: np.ndarray) -> np.ndarray:
    """The whole part of the square root."""
    r = np.sqrt(np.asarray(n, np.float64)).astype(np.int64)
    r -= r * r > n
    return r + ((r + 1) * (r + 1) <= n)


def root_up(n: np.ndarray) -> np.ndarray:
    r = root_down(n)
    return r + (r * r < n)


@dataclass
class Node:
    """entries: the vantage point alone, or all of a leaf; near and far: the halves, with the bounds of their distances."""

    entries: np.ndarray
    near: Node | None = None
    far: Node | None = None
    near_most: int = 0
    far_least: int = 0


def _squared(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    d = points - entry
    return np.einsum("ij,ij->i", d, d)


def grow(book: np.ndarray, entries: np.ndarray) -> Node:
    """A tree over some entries of a codebook; the vantage point is the entry farthest from the first one."""
    if len(entries) <= LEAF:
        return Node(entries)
    point = entries[int(np.argmax(_squared(book[entries], book[entries[0]])))]
    others = entries[entries != point]
    squared = _squared(book[others], book[point])
    order = np.argsort(squared, kind="stable")
    near, far = order[: len(order) // 2], order[len(order) // 2 :]
    return Node(np.array([point]), grow(book, np.sort(others[near])), grow(book, np.sort(others[far])), int(root_up(squared[near].max())), int(root_down(squared[far].min())))


class Search:
    """The nearest entry of each of many points."""

    def __init__(self, book: np.ndarray, tree: Node, points: np.ndarray):
        self.book, self.points = book, points
        self.best = np.full(len(points), np.iinfo(np.int64).max)
        self.index = np.full(len(points), len(book))
        self.seen = 0
        self._visit(tree, np.arange(len(points)))

    def _visit(self, node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        own = self.points[rows]
        for e in node.entries:
            squared = _squared(own, self.book[e])
            better = (squared < self.best[rows]) | ((squared == self.best[rows]) & (e < self.index[rows]))
            self.best[rows[better]], self.index[rows[better]] = squared[better], e
        self.seen += len(rows) * len(node.entries)
        if node.near is None:
            return
        low, high = root_down(squared), root_up(squared)
        first_near = 2 * low <= node.near_most + node.far_least
        for near_turn in (True, False):
            for half, rest in ((node.near, first_near), (node.far, ~first_near)):
                turn = rest if near_turn else ~rest
                gap = low - node.near_most if half is node.near else node.far_least - high
                self._visit(half, rows[turn & (gap <= root_up(self.best[rows]))])


class Books:
    """Codebooks as an array of part, entry and component, with their trees."""

    def __init__(self, books: np.ndarray):
        self.books = books
        self.trees = [grow(b, np.arange(len(b))) for b in books]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each vector's parts."""
        parts = vectors.reshape(len(vectors), len(self.books), -1)
        found = [Search(b, t, np.ascontiguousarray(parts[:, i])) for i, (b, t) in enumerate(zip(self.books, self.trees))]
        return np.stack([f.index for f in found], 1), np.stack([f.best for f in found], 1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    """Some thousand vectors at a time, with the place of the first."""
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
    for at in range(0, batch.num_rows, ROWS):
        yield at, values[at : at + ROWS]


def improve(vectors: DataFrame, books: Books) -> Books:
    """One round of assignment and means."""
    sent = broadcast_value(vectors.sparkSession, books)
    n_parts, n_entries, width = books.books.shape

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((n_parts * n_entries, width), np.int64), np.zeros(n_parts * n_entries, np.int64)
        for batch in batches:
            for _, own in _blocks(batch, 0):
                slots = (sent.value.assign(own)[0] + np.arange(n_parts) * n_entries).ravel()
                np.add.at(sums, slots, own.reshape(-1, width))
                counts += np.bincount(slots, minlength=len(counts))
        used = np.flatnonzero(counts)
        slots = np.repeat(used, width)
        place = np.tile(np.arange(width), len(used))
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(place), pa.array(sums[used].ravel()), pa.array(counts[slots])], names=["slot", "place", "total", "n"])

    found = vectors.select("v").mapInArrow(step, "slot long, place long, total long, n long").groupBy("slot", "place").agg(F.sum("total"), F.sum("n")).collect()
    after = books.books.reshape(-1, width).copy()
    for slot, place, total, n in found:
        after[slot, place] = total // n
    return Books(after.reshape(books.books.shape))


def train(vectors: DataFrame) -> Books | None:
    """Codebooks from rows of ``whole``, all of one length; None without rows."""
    first = np.array([r["v"] for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()], np.int64)
    if not len(first):
        return None
    books = Books(first.reshape(len(first), PARTS, -1).transpose(1, 0, 2))
    for _ in range(ROUNDS):
        books = improve(vectors, books)
    return books


def encode(vectors: DataFrame, books: Books) -> DataFrame:
    """vec_id, label, code and error of each row of ``whole``."""
    sent = broadcast_value(vectors.sparkSession, books)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [], []
            for _, own in _blocks(batch, 2):
                index, squared = sent.value.assign(own)
                codes += [bytes(row).hex() for row in index.astype(np.uint8)]
                errors += squared.sum(1).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "v").mapInArrow(step, f"vec_id long, label {label}, code string, error long")


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row."""
    prepare(vectors.sparkSession)
    rows = whole(vectors)
    head = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v")).where((F.size("v") > 0) & (F.size("v") % PARTS == 0)).first()
    rows = rows.where(F.size("v") == (head[0] if head else -1))
    books = train(rows)
    if books is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = materialize(encode(rows, books), "part-codes")
    sums = coded.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error"))
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_KEYS else sums
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("own")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
