"""How far the sources of a language differ in their words, by dense tiles of term blocks.

A group is a language and a source; a language keeps the terms that MIN_DOCS of its documents hold. With n a
term's count in a group, N the group's sum over kept terms and V their number, the group's share of the
term is p = 1 + floor(10^9 (n + 1) / (N + V)), and f(p, q) = floor((p - q)^2 / q) its divergence from a share q.
A group's divergence from another source is f summed over all kept terms; its own terms are those with p above
the language's share, by f. All arithmetic is in whole numbers.

* Counting: tasks count terms and documents by group and hand out what they hold when that grows large, so
  a hot source or word has a row a task. Counts meet by language and term in one shuffle; languages and
  sources are never the key of rows that grow with the texts.
* Tiles: the terms of a language are dealt by hash to blocks of some BLOCK_TERMS, its groups to chunks of some
  CHUNK_GROUPS. A tile is a block and two chunks: an int64 matrix, group by term, in which all pairs
  of groups are computed by broadcasting, some terms at a time. Each tile holds a row for every group of its
  chunks, so each pair comes out even where no term does. Terms of the language that no group of a tile holds
  are left out of its matrix; all of them have the same f, which is added for their number at the end.
* Partial sums of pairs, and heaps of each group's TOP terms, are merged by task, then by group.

The table of groups is broadcast when it has BROADCAST_KEYS rows at most and shuffled beyond that; a
tile has some 2 * CHUNK_GROUPS * BLOCK_TERMS cells at most, however large the input.

Defined results: null text, language and source count as ''. A group without terms has its rows; a language
with one source has no pairs; without kept terms all pairs are 0 and there are no terms. Repeated rows
count each, equal values go by item in UTF-8 order, an empty table gives no row. Texts needn't be valid UTF-8: bytes
from 0x80 on are letters. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, materialize, prepare

SCALE, MIN_DOCS, TOP = 1_000_000_000, 3, 200
BLOCK_TERMS, CHUNK_GROUPS = 1024, 64
#: Cells of a pair computation, entries that a counting or merging task holds, bytes of a text taken at a time.
CELLS, HELD, PIECE = 1 << 19, 300_000, 4 << 20
#: Letters as they are, A-Z lower-cased, bytes of longer characters as they are; all else parts terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some megabytes of it at a time."""
    at = 0
    while at < len(raw):
        piece = raw[at : at + PIECE].translate(_FOLD)
        if at + PIECE < len(raw):
            end = piece.rfind(b" ") + 1
            while not end:  # a term longer than a piece
                more = raw[at + len(piece) : at + 2 * len(piece)].translate(_FOLD)
                piece += more
                end = piece.rfind(b" ") + 1 if more else len(piece)
            piece = piece[:end]
        at += len(piece)
        yield piece.split()


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term (binary), n occurrences and n_docs documents; a group's counts lie in several rows."""
    prepare(docs.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, n_docs) in held.items():
                terms = list(n)
                ends = [pa.array([x] * len(terms), pa.binary()) for x in (lang, source)]
                counts = [pa.array([c[t] for t in terms], pa.int64()) for c in (n, n_docs)]
                yield pa.RecordBatch.from_arrays([*ends, pa.array(terms, pa.binary()), *counts], names=["lang", "source", "term", "n", "n_docs"])
            held.clear()

        for batch in batches:
            for lang, source, raw in zip(*(c.to_pylist() for c in batch.columns)):
                n, n_docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(n), set()
                for terms in _pieces(raw):
                    n.update(terms)
                    own.update(terms)
                n_docs.update(own)
                size += len(n) - before
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()

    rows = docs.select(_text(docs["lang"]), _text(docs["source"]), _text(docs["text"]))
    return rows.mapInArrow(step, "lang binary, source binary, term binary, n long, n_docs long")


def kept_cells(docs: DataFrame) -> DataFrame:
    """lang, source, term, n of the kept terms; all_n: the language's count; first: true once a term."""
    by_term = Window.partitionBy("lang", "term")
    cells = count_terms(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    whole = cells.withColumns({"all_docs": F.sum("n_docs").over(by_term), "all_n": F.sum("n").over(by_term), "first": F.min("source").over(by_term) == F.col("source")})
    return whole.where(F.col("all_docs") >= MIN_DOCS).select("lang", "source", "term", "n", "all_n", "first")


def groups(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """Every group with its sum, its language's sum and number of terms, and how the language is dealt."""
    every = docs.select(_text(docs["lang"]).alias("lang"), _text(docs["source"]).alias("source")).distinct()
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = cells.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("first").cast("long")).alias("kinds"))
    sizes = every.groupBy("lang").agg(F.count("*").alias("n_groups"))
    joined = every.join(sizes, "lang").join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "lang_total", "kinds"])
    over = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int")
    dealt = joined.withColumns({"blocks": over("kinds", BLOCK_TERMS), "chunks": over("n_groups", CHUNK_GROUPS)})
    return dealt.withColumn("chunk", F.pmod(F.xxhash64("source"), F.col("chunks")).cast("int")).drop("n_groups")


def shares(n: np.ndarray, total: np.ndarray, kinds: int) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / (total + kinds)), by long division in base 1000, so that nothing overflows."""
    by = np.maximum(np.asarray(total, np.int64) + kinds, 1)
    rest, out = np.asarray(n, np.int64) + 1, 0
    for _ in range(3):
        q, rest = np.divmod(rest * 1000, by)
        out = out * 1000 + q
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


_PART = "part string, lang binary, source binary, item binary, value long, n_terms long, rest long, kinds long"
_NAMES = [f.split()[0] for f in _PART.split(", ")]
_TYPES = [pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def _tile(key: tuple, table: pa.Table) -> pa.Table:
    """Partial sums of a tile's pairs; of a tile whose chunks are one, its groups' dearest terms as well."""
    lang, _, low, high = (k.as_py() for k in key)
    is_cell = np.asarray(table["term"].is_valid())
    heads, cells = table.filter(pa.array(~is_cell)), table.filter(pa.array(is_cell))
    names = heads["source"].to_pylist()
    total, chunk = heads["total"].to_numpy(), heads["chunk"].to_numpy()
    kinds, lang_total = heads["kinds"][0].as_py(), heads["lang_total"][0].as_py()
    place = {s: i for i, s in enumerate(names)}
    coded = cells["term"].cast(pa.binary()).combine_chunks().dictionary_encode()
    terms, at = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    source = np.array([place[s] for s in cells["source"].to_pylist()], np.int64)
    n, all_n = np.zeros((len(names), len(terms)), np.int64), np.zeros(len(terms), np.int64)
    n[source, at] = cells["n"].to_numpy()
    all_n[at] = cells["all_n"].to_numpy()
    p, unseen = shares(n, total[:, None], kinds), shares(np.zeros_like(total), total, kinds)
    rows: list[tuple] = []
    a, b = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
    for one, other in ((a, b),) if low == high else ((a, b), (b, a)):
        sums = np.zeros((len(one), len(other)), np.int64)
        width = max(1, CELLS // max(1, sums.size))
        for i in range(0, len(terms), width):
            sums += divergence(p[one, None, i : i + width], p[None, other, i : i + width]).sum(-1)
        rest = divergence(unseen[one, None], unseen[None, other])
        rows += [("pair", lang, names[x], names[y], int(sums[i, j]), len(terms), int(rest[i, j]), kinds) for i, x in enumerate(one) for j, y in enumerate(other) if x != y]
    if low == high and terms:
        q = shares(all_n, np.int64(lang_total), kinds)
        order = np.empty(len(terms), np.int64)
        order[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))
        for i, name in enumerate(names):
            own = np.flatnonzero((n[i] > 0) & (p[i] > q))
            value = divergence(p[i, own], q[own])
            rows += [("term", lang, name, terms[own[k]], int(value[k]), 0, 0, kinds) for k in np.lexsort((order[own], -value))[:TOP]]
    return pa.Table.from_batches([_batch(rows)])


class _Entry:
    """A term in a heap: the least valuable one, of equals the last in order, is on top."""

    __slots__ = ("row",)

    def __init__(self, row: tuple):
        self.row = row

    def __lt__(self, other: _Entry) -> bool:
        return (self.row[4], other.row[3]) < (other.row[4], self.row[3])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's partial sums of a pair as one, and its heaps of a group as one."""
    sums: dict[tuple, list[int]] = {}
    heaps: dict[tuple, list[_Entry]] = {}

    def out() -> pa.RecordBatch:
        rows = [("pair", *k, *v) for k, v in sums.items()] + [e.row for h in heaps.values() for e in h]
        sums.clear()
        heaps.clear()
        return _batch(rows)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] == "pair":
                held = sums.setdefault(row[1:4], [0, 0, *row[6:]])
                held[0] += row[4]
                held[1] += row[5]
                continue
            heap, entry = heaps.setdefault(row[1:3], []), _Entry(row)
            if len(heap) < TOP:
                heapq.heappush(heap, entry)
            elif heap[0] < entry:
                heapq.heapreplace(heap, entry)
        if len(sums) + TOP * len(heaps) > HELD:
            yield out()
    yield out()


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank."""
    cells = materialize(kept_cells(docs), "divergence-cells")
    every = materialize(groups(docs, cells), "divergence-groups")
    dealt = every.select("lang", "source", "blocks", "chunks", "chunk")
    dealt = F.broadcast(dealt) if every.count() <= BROADCAST_KEYS else dealt
    partner = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("partner")
    placed = cells.join(dealt, ["lang", "source"]).select("*", partner).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    heads = every.select("*", partner).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    tile = [F.col("lang"), F.col("block"), F.least("chunk", "partner").alias("low"), F.greatest("chunk", "partner").alias("high"), F.col("source")]
    none = lambda *names: [F.lit(None).cast("long").alias(c) for c in names]
    rows = placed.select(*tile, "term", "n", "all_n", *none("total", "lang_total", "kinds"), F.lit(None).cast("int").alias("chunk")).unionByName(
        heads.select(*tile, F.lit(None).cast("binary").alias("term"), *none("n", "all_n"), "total", "lang_total", "kinds", "chunk")
    )
    found = rows.groupBy("lang", "block", "low", "high").applyInArrow(_tile, _PART).mapInArrow(_merge, _PART)
    whole = found.groupBy("part", "lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("n_terms").alias("n_terms"), F.first("rest").alias("rest"), F.first("kinds").alias("kinds"))
    whole = materialize(whole, "divergence-sums")
    value = F.col("value") + (F.col("kinds") - F.col("n_terms")) * F.col("rest")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = whole.where("part = 'pair'").withColumn("value", value).withColumn("rank", rank)
    terms = whole.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= TOP)
    text = lambda c: F.col(c).cast("string").alias(c)
    return pairs.unionByName(terms).select(text("lang"), text("source"), "part", text("item"), "value", "rank")
