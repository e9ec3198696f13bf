"""SimHash near-duplicates, their links found with pivot distance tables.

A text's words (ASCII letters lower-cased, split at ASCII white space) give shingles of three words;
bit i of the 64-bit fingerprint is 1 if it is set in more than half of the shingles' XXH64 hashes.
Fingerprints link at MAX_BITS = 2 differing bits or fewer, and a class is what links reach.

Links between *distinct* fingerprints (copies share one, so they cost nothing) are found so:

1. Blocking. 64 bits are cut into 3 bands, and the rest of each into 3 again. Two fingerprints that
   differ in 2 bits or fewer agree on a band, and on one of its sub-bands, so each fingerprint
   goes under 9 keys of about 35 bits and no link is lost. A key's rows differ in 29 bits at most.
   Keys of more than HOT fingerprints are cut again in the same way, by the 28 or 29 bits left, and dealt
   by the longer keys, under which there are 2 ** 20 fingerprints at most. What a task gets for one key is
   cut once more, by the bits that still vary, until PART or fewer are left.
2. Pivot table. Each fingerprint's Hamming distances to PIVOTS fixed reference fingerprints are
   computed once. In a part, rows are sorted by the first distance; as |d(x,p) - d(y,p)| <= d(x,y),
   only rows within 2 of each other there are paired, and a pair is discarded if any coordinate
   differs by more than 2.
3. Survivors are verified by the exact distance. Each task joins what it has verified into trees,
   so a dense group of n fingerprints leaves n - 1 links, not n * n / 2.

Links are joined into classes by alternating large-star and small-star rounds, each cut by a
written table. Nothing of this reaches the driver.

Defined results: a null or empty text has the fingerprint zero and links as any other; a text of any length
is taken whole, its hashes a part at a time; a bit set in exactly half of the hashes is 0; a row without
doc_id takes part, but a class is named by its smallest doc_id (null if it has none); repeated rows
are all returned; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, drop_table, materialize, prepare, rows_by_key, same, text_hash

SHINGLE, SEED, MAX_BITS, PIVOTS = 3, 42, 2, 24
#: Bit ranges of the bands; each band's sub-bands cut the 42 or 43 other bits.
BANDS = ((0, 22), (22, 43), (43, 64))
#: Fingerprints of a key from which on it is cut and dealt anew, and of a part that is compared.
HOT, PART = 1 << 16, 512
#: Hot keys that are broadcast at most; more meet their rows in a shuffle, dealt to SALTS parts.
BROADCAST_HOT, SALTS = 200_000, 16


def fingerprint(raw: bytes | None) -> int:
    """The text's fingerprint, unsigned."""
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    digest = xxhash.xxh64_intdigest
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[SHINGLE - 1 :].tolist())), np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes: counted by byte, 65,535 hashes at a time."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint as a signed long) of each row."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signed(fingerprint(raw)) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.int64())], names=["doc_id", "text_hash", "fp"])

    return doc_columns(docs, text_hash(docs).alias("text_hash")).mapInArrow(step, "doc_id long, text_hash long, fp long")


def _bits(x: Column, lo: int, hi: int) -> Column:
    return F.shiftrightunsigned(x, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) if hi - lo < 64 else x


def blocking_keys(fps: DataFrame) -> DataFrame:
    """fp under each of its nine keys: (band, sub-band, their values) packed into one long."""
    keys = []
    for b, (lo, hi) in enumerate(BANDS):
        band = _bits(F.col("fp"), lo, hi)
        rest = F.shiftleft(_bits(F.col("fp"), hi, 64), lo) if hi < 64 else F.lit(0).cast("long")
        rest = rest.bitwiseOR(_bits(F.col("fp"), 0, lo)) if lo else rest
        free = 64 - (hi - lo)
        cuts = [free * i // 3 for i in range(4)]
        for s in range(3):
            sub = _bits(rest, cuts[s], cuts[s + 1])
            tag = F.lit(b * 3 + s).cast("long")
            keys.append(F.shiftleft(tag, 40).bitwiseOR(F.shiftleft(band, 15)).bitwiseOR(sub))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints: hashes of their number."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(n)], np.uint64)


def distance_table(fps: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each reference."""
    return np.stack([np.bitwise_count(fps ^ p) for p in references], axis=1).astype(np.int8) if len(fps) else np.zeros((0, len(references)), np.int8)


def measured(fps: np.ndarray, n: int) -> np.ndarray:
    """Hamming distances of fingerprints (rows of words) to ``n`` pivots among them: the first, then always the one farthest
    from all pivots before it, while there are any that differ."""
    columns, least, at = [], None, 0
    while len(columns) < min(n, len(fps)):
        columns.append(np.bitwise_count(fps ^ fps[at]).sum(axis=1, dtype=np.int16))
        least = columns[-1] if least is None else np.minimum(least, columns[-1])
        at = int(least.argmax())
        if not least[at]:
            break
    return np.stack(columns, axis=1)


def within(fps: np.ndarray, table: np.ndarray, x: np.ndarray, y: np.ndarray, bits: int, seen: list[int] | None = None) -> np.ndarray:
    """The places of the pairs x-y whose fingerprints differ in ``bits`` or fewer: those that a coordinate of ``measured`` tells
    apart are discarded first. ``seen`` counts pairs, those left by the pivots, and those left by the distance."""
    at = np.arange(len(x))
    counts = [len(at)]
    for p in range(table.shape[1]):
        if not len(at):
            break
        at = at[np.abs(table[x[at], p] - table[y[at], p]) <= bits]
    counts.append(len(at))
    at = at[np.bitwise_count(fps[x[at]] ^ fps[y[at]]).sum(axis=1) <= bits]
    counts.append(len(at))
    if seen is not None:
        seen[:] = [a + b for a, b in zip(seen, counts)]
    return at


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links that join the same nodes as the links a-b: (node, the least node it reaches)."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


#: Verified links that a task holds before it joins them into trees.
HELD = 1 << 20


def _cut(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """Those bits of each value, packed."""
    out = np.zeros(len(values), np.uint64)
    for k, b in enumerate(bits):
        out |= (values >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
    return out


def _parts(fps: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Parts of ``size`` or few fingerprints more, such that any two within MAX_BITS share one."""
    todo = [fps]
    while todo:
        own = todo.pop()
        varying = np.bitwise_or.reduce(own ^ own[0])
        bits = [b for b in range(64) if int(varying) >> b & 1]
        if len(own) <= size or len(bits) <= 3 * (MAX_BITS + 1):
            yield own
            continue
        cuts = [len(bits) * i // (MAX_BITS + 1) for i in range(MAX_BITS + 2)]
        for lo, hi in zip(cuts, cuts[1:]):
            value = _cut(own, bits[lo:hi])
            order = np.argsort(value, kind="stable")
            todo += [g for g in np.split(own[order], np.flatnonzero(np.diff(value[order])) + 1) if len(g) > 1]


def _near(fps: np.ndarray, references: np.ndarray, seen: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within MAX_BITS, found by the pivots' distances. ``seen`` counts pairs left by the first pivot,
    by all pivots, and by the exact distance."""
    table = distance_table(fps, references)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    first = table[:, 0]
    at, step = np.arange(len(fps)), 0
    while len(at):
        step += 1
        at = at[at + step < len(fps)]
        at = at[first[at + step] - first[at] <= MAX_BITS]  # sorted: beyond a miss there is nothing nearer
        x, y = at, at + step
        if seen is not None:
            seen[0] += len(x)
        for p in range(1, table.shape[1]):  # the next coordinate looks at what is left
            ok = np.abs(table[x, p] - table[y, p]) <= MAX_BITS
            x, y = x[ok], y[ok]
            if not len(x):
                break
        if seen is not None:
            seen[1] += len(x)
        ok = np.bitwise_count(fps[x] ^ fps[y]) <= MAX_BITS
        if seen is not None:
            seen[2] += int(ok.sum())
        if ok.any():
            yield fps[x[ok]], fps[y[ok]]


def _link(keys: np.ndarray, fps: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints under equal keys."""
    order = np.argsort(keys, kind="stable")
    keys, fps = keys[order], fps[order]
    left, right, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], 0
    for group in np.split(fps, np.flatnonzero(np.diff(keys)) + 1):
        if len(group) < 2:
            continue
        for part in _parts(group, PART):
            for a, b in _near(part, references):
                left.append(a)
                right.append(b)
                held += len(a)
                if held > HELD:
                    a, b = forest(np.concatenate(left), np.concatenate(right))
                    left, right, held = [a], [b], 0
    return forest(np.concatenate(left), np.concatenate(right))


def _free_bits(tag: int) -> list[int]:
    """The bits that a key of blocking_keys leaves open."""
    (lo, hi), s = BANDS[tag // 3], tag % 3
    rest = [*range(lo), *range(hi, 64)]
    cuts = [len(rest) * i // 3 for i in range(4)]
    return rest[: cuts[s]] + rest[cuts[s + 1] :]


def _longer_keys(rows: DataFrame) -> DataFrame:
    """key and fp for each of the three parts of the bits that the rows' keys leave open."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for tag in np.unique(keys >> 40).tolist():
                here = np.flatnonzero(keys >> 40 == tag)
                bits = _free_bits(tag)
                cuts = [len(bits) * i // 3 for i in range(4)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    # a hash: keys that fall together cost comparisons and no link
                    longer = [xxhash.xxh64_intdigest(b, SEED) - (1 << 63) for b in np.stack([keys[here].view(np.uint64), _cut(fps[here], bits[lo:hi]), np.full(len(here), k, np.uint64)], axis=1).astype("<u8").view("V24").ravel().tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(longer, pa.int64()), pa.array(fps[here].view(np.int64))], names=["key", "fp"])

    return rows.select("key", "fp").mapInArrow(step, "key long, fp long")


def _cut_hot(keyed: DataFrame, hot_size: int) -> DataFrame:
    """The rows with those under hot keys dealt to longer ones."""
    hot = materialize(keyed.groupBy("key").count().where(F.col("count") > hot_size).select("key"), "hot")
    n = hot.count()
    if not n:
        return keyed
    if n <= BROADCAST_HOT:
        marked = keyed.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "key", "left")
    else:
        salted = hot.select("key", F.lit(True).alias("hot"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        marked = keyed.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left")
    return marked.where("hot is null").select("key", "fp").unionByName(_longer_keys(marked.where("hot")))


def links(fps: DataFrame, references: int = PIVOTS, hot_size: int = HOT) -> DataFrame:
    """Links a-b between distinct fingerprints, enough of them to reach what all links reach."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pivots(references)
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def out(held):
            a, b = _link(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]), table)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:  # sorted by key; the last key's rows wait for the next batch
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield out([*kept, (keys[:cut], fps[:cut])])
                kept = []
            elif kept and kept[-1][0][-1] != keys[0]:
                yield out(kept)
                kept = []
            kept.append((keys[cut:], fps[cut:]))
        if kept:
            yield out(kept)

    prepare(fps.sparkSession)
    keyed = _cut_hot(blocking_keys(fps), hot_size)
    parts = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(step, "a long, b long")


def classes(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its class) for every node that has a link.

    Alternates large-star (each larger neighbour of u is linked to u's least neighbour) and
    small-star (each smaller neighbour likewise) until a round changes nothing, which takes about
    log(n) rounds. Least neighbours are pre-aggregated, and the joins that hand them out are plain
    shuffle joins, which Spark splits where a hub is hot."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = materialize(small, "links")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(edges)
        edges = after
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def components(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, root (the class, by one of its fingerprints) and component_id of every row."""
    prints = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = classes(links(distinct.select("fp")))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "roots")
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(best, "root").select("fp", "root", "component_id")
    return prints.join(labels, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Of each class one row, with all columns: the smallest doc_id (none comes last), then the least
    text hash; of rows that repeat it, one. Rows of another class stay even if they share a doc_id.
    Classes are those of ``components``, or ``found`` (doc_id, text_hash and root of every row)."""
    found = components(docs) if found is None else found
    keys = materialize(found.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n")), "keys")
    least = keys.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("one"))
    best = least.select("root", F.col("one.doc_id").alias("b_id"), F.col("one.text_hash").alias("b_hash"), F.lit(True).alias("best"))
    # joined by the whole key, so that a large class is no hot one
    own = (keys["root"] == best["root"]) & same(F.col("doc_id"), F.col("b_id")) & (F.col("text_hash") == F.col("b_hash"))
    marked = materialize(keys.join(best, own, "left").select("doc_id", "text_hash", "n", F.col("best").isNotNull().alias("kept")), "kept")
    repeated = marked.where("kept and n > 1")
    single = rows_by_key(docs, marked.where("not kept or n > 1"), matching=False).select("row.*")
    if repeated.isEmpty():
        return single
    again = rows_by_key(docs, repeated, matching=True).groupBy("id", "hash").agg(F.first("row").alias("row"))
    return single.unionByName(again.select("row.*"))
