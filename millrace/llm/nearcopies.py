"""Classes of near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The corpus pipeline's near-dedup takes these classes. They are found by SimHash with a pivot table, as in ``simhash``,
with parameters of their own: at a similarity of 0.8 fingerprints of 64 bits differ in some 10 bits and unrelated ones in
32 with a deviation of 4, which is too close for pivots to tell them apart. So fingerprints have 256 bits here, those of a
link differ in some 39, unrelated ones in 128, and RADIUS is 80; and the pivots are texts of the block, so that one is
near its own copies and far from all others. No band of bits blocks pairs that far apart; least hashes do.

Words are those of ``simhash`` (ASCII letters lower-cased, split at ASCII white space). Texts with a
similarity of SIMILARITY or more are linked, and a class is what links reach. Texts of equal shingle
sets share a *node*, so exact copies cost nothing. Links between nodes are found so:

1. Blocking. BANDS keys of ROWS least hashes each (MinHash); texts are compared if they agree on a
   key. A pair is missed with probability (1 - s ** ROWS) ** BANDS: 7e-5 at a similarity s of 0.8,
   2e-7 at 0.85.
2. Rare shingles. Of the texts under a key, those that a template made share most shingles without being alike enough.
   So a shingle that more than HEAVY of them hold compares no one. A link shares 0.8 of either text; what a text has
   no heavy shingles for must be shared among its rare ones, hence one of its rarest (prefix filter): pairs that
   share one are verified. Only a text of which heavy shingles are 0.8 or more may be linked without a rare
   one, and then one of the two has rare shingles of an eighth of its heavy ones at most (else the union
   is too large): such *core* texts remain.
3. Stars. Core texts are kept as stars, each text within 0.2 (Jaccard distance) of its star's centre. As
   |d(x, p) - d(y, p)| <= d(x, y), a text is compared only with stars whose centre is within 0.4 of it, and
   there only with texts whose distances differ by 0.2 or less. Near texts that aren't core are compared with
   stars and make none. Texts known to be of one class aren't compared. Nothing is capped and no link is lost here.
4. SimHash. Whatever 2 and 3 bring together is a candidate only. Fingerprints' Hamming distances to PIVOTS texts of the block
   are computed once; a pair is discarded if a coordinate differs by more than RADIUS, then if its fingerprints
   do. A bit differs with probability 0.19 at most at a similarity of 0.8 (sets of four and five shingles; 0.152
   for large ones), so a link is lost with probability 6e-7 at most, and 3e-11 for large sets.
5. What survives is verified by the exact similarity of the whole shingle sets (64-bit hashes).

Large blocks are first compared in parts of about PART texts, which joins most of a large class; then every block that
still holds several classes is compared whole, one of more than CHUNK texts in parts of which any two meet in a task.
The time of a task is linear in its texts unless many core texts are far from each other, which takes texts made of
frequent lines in ever different choices. Sets of shingles and fingerprints are made and shuffled only for texts in such
blocks. Nothing of this reaches the driver.

Defined results: rows without a word are one class; a text of fewer than five words is one shingle;
repeated rows are all returned. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, drop_table, materialize, release, rows_by_key, text_hash
from .simhash import classes, majority, measured, within

SHINGLE, SIMILARITY, BANDS, ROWS, SEED = 5, 0.8, 24, 5, 42
#: Bands of the first comparison, and the texts of one part there.
FIRST, PART = 6, 256
#: A shingle that more texts of a block hold is no reason to compare them; texts of a part of a large block.
HEAVY, CHUNK = 64, 8192
#: Bits that fingerprints of linked texts differ in at most, of 64 for each of _WORD; texts of a block that serve as pivots.
RADIUS, PIVOTS = 80, 16
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLY = np.array([xxhash.xxh64_intdigest(f"m{i}".encode(), SEED) | 1 for i in range(BANDS * ROWS)], np.uint64)
_BAND = np.array([xxhash.xxh64_intdigest(f"b{i}".encode(), SEED) for i in range(BANDS)], np.uint64)
_WORD = np.array([xxhash.xxh64_intdigest(f"w{i}".encode(), SEED) for i in range(4)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(raw: bytes | None) -> np.ndarray:
    """The sorted, distinct hashes of the text's shingles."""
    words = raw.lower().split() if raw else []
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(map(digest, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    count = len(words) - width + 1
    found = np.full(count, width, np.uint64)
    for k in range(width):
        found = _mixed(found * _FACTOR + hashes[k : k + count])
    return np.unique(found)


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The set's SimHash fingerprint, 64 bits for each of _WORD; zero for the empty set."""
    return np.array([majority(_mixed(found ^ word)) for word in _WORD], np.uint64)


def node(found: np.ndarray) -> int:
    """One signed long for a set of shingles."""
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


def band_keys(found: np.ndarray) -> np.ndarray:
    """The set's BANDS keys, as signed longs; the empty set has none."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 512):
        np.minimum(least, _mixed(found[at : at + 512, None] * _MULTIPLY).min(axis=0), out=least)
    keys = _BAND.copy()
    for k in range(ROWS):
        keys = _mixed(keys * _FACTOR + least[k::ROWS])
    return keys.view(np.int64)


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node and band keys of each row."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            sets = [shingles(raw) for raw in batch.column(1).to_pylist()]
            arrays = [batch.column(0), batch.column(2), pa.array([node(s) for s in sets], pa.int64()), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_hash", "node", "keys"])

    return doc_columns(docs, text_hash(docs).alias("text_hash")).mapInArrow(step, "doc_id long, text_hash long, node long, keys array<long>")


def candidates(sets: list[np.ndarray], roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with sorted shingles: pairs (two columns, of different roots) that share a rare shingle as links without
    known roots must, the numbers of near texts in order of their rare shingles, and which of those are core."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    shingle, freq = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    owner, freq = np.repeat(np.arange(len(sets)), sizes), freq[shingle]
    rare = freq <= HEAVY
    owner, shingle, freq = owner[rare], shingle[rare], freq[rare]
    r = np.bincount(owner, minlength=len(sets))
    heavy = sizes - r
    least = (4 * sizes + 4) // 5 - heavy  # rare shingles that a link shares: 0.8 of the text, less the others
    order = np.lexsort((shingle, freq, owner))
    owner, shingle = owner[order], shingle[order]
    place = np.arange(len(owner)) - np.repeat(np.cumsum(r) - r, r)
    prefix = place < (r - np.maximum(least, 1) + 1)[owner]
    owner, shingle = owner[prefix], shingle[prefix]
    order = np.argsort(shingle, kind="stable")
    owner, shingle = owner[order], shingle[order]
    pairs = [np.zeros((0, 2), np.int64)]
    for gap in range(1, HEAVY):
        same = np.flatnonzero(shingle[gap:] == shingle[:-gap])
        if not len(same):
            break
        one, other = owner[same], owner[same + gap]
        pairs.append(np.unique(np.stack((one, other), 1)[roots[one] != roots[other]], axis=0))
    near = np.flatnonzero(least <= 0)
    near = near[np.argsort(r[near], kind="stable")]
    return np.unique(np.concatenate(pairs), axis=0), near, 8 * r[near] <= heavy[near], sizes


def block_links(nodes: list[int], roots: list[int], sets: list[np.ndarray], fps: np.ndarray | None = None, seen: list[int] | None = None) -> list[tuple[int, int]]:
    """Verified links that join what similarity joins among these texts (sorted shingles), beyond their known roots. ``fps``
    has their fingerprints as rows; ``seen`` counts pairs brought together, left by the pivots, left by the fingerprints."""
    far = 1 - SIMILARITY
    fps = np.stack([fingerprint(s) for s in sets]) if fps is None else fps
    table = measured(fps, PIVOTS)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    pairs, near_texts, is_core, sizes = candidates(sets, np.asarray(roots))
    out = []

    def join(i: int, j: int) -> None:
        out.append((nodes[i], nodes[j]))
        parent[find(roots[i])] = find(roots[j])

    last, own = -1, set()
    for i, j in pairs[within(fps, table, pairs[:, 0], pairs[:, 1], RADIUS, seen)].tolist():
        if find(roots[i]) != find(roots[j]) and 5 * min(sizes[i], sizes[j]) >= 4 * max(sizes[i], sizes[j]):
            if i != last:
                last, own = i, set(sets[i].tolist())
            if 9 * len(own.intersection(sets[j].tolist())) >= 4 * (sizes[i] + sizes[j]):
                join(i, j)
    #: class: its stars, each a centre, the centre's set and the texts as (distance, number), sorted
    stars: dict[int, list[tuple[set, list[tuple[float, int]]]]] = {}

    def distance(a: set, j: set | list) -> float:
        if min(len(a), len(j)) < (1 - 2 * far - 1e-9) * max(len(a), len(j)):
            return 1.0  # beyond twice ``far`` whatever they share
        both = len(a.intersection(j))
        return 1 - both / (len(a) + len(j) - both)

    def near(i: int, a: set, group: list) -> int | None:
        for centre, texts in group:
            d = distance(a, centre)
            if d <= 2 * far + 1e-9:
                others = np.array([j for _, j in texts[bisect_left(texts, (d - far - 1e-9, -1)) :]], np.int64)
                for at in range(0, len(others), PART):  # a centre comes first, and is mostly the one
                    part = others[at : at + PART]
                    for j in part[within(fps, table, np.full(len(part), i), part, RADIUS, seen)].tolist():
                        if distance(a, sets[j].tolist()) <= far + 1e-9:
                            return j
        return None

    for i, core in zip(near_texts.tolist(), is_core.tolist()):
        a = set(sets[i].tolist())
        for other in list(stars):
            if other not in stars or (root := find(other)) == find(roots[i]):
                continue
            if (j := near(i, a, stars[other])) is not None:
                join(i, j)
                root = find(roots[i])
            if root != other:
                stars.setdefault(root, []).extend(stars.pop(other))
        if core:
            group = stars.setdefault(find(roots[i]), [])
            for centre, texts in group:
                if (d := distance(a, centre)) <= far + 1e-9:
                    insort(texts, (d, i))
                    break
            else:
                group.append((a, [(0.0, i)]))
    return out


def _linked(blocks: DataFrame) -> DataFrame:
    """Links a-b of blocks (key, node, root, shingles, fp), sorted by key."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            found = block_links([r[0] for r in rows], [r[1] for r in rows], [np.frombuffer(r[2], "<u8") for r in rows], np.stack([np.frombuffer(r[3], "<u8") for r in rows])) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        release()
        key, rows = None, []
        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if len(rows) > 1:
                        yield out(rows)
                    key, rows = k, []
                rows.append(row)
        yield out(rows)

    parts = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return blocks.repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(step, "a long, b long")


def _sets(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """node, shingles and fp, the fingerprint (both as little-endian longs), of the rows (doc_id, text_hash)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(raw) for raw in batch.column(0).to_pylist()]
            raw = lambda arrays: pa.array([x.astype("<u8").tobytes() for x in arrays], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([node(s) for s in sets], pa.int64()), raw(sets), raw(map(fingerprint, sets))], names=["node", "shingles", "fp"])

    texts = rows_by_key(docs, rows, matching=True).select(F.col("row.text").cast("string").cast("binary").alias("raw"))
    return texts.mapInArrow(step, "node long, shingles binary, fp binary")


def labels(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and root (the class) of every row."""
    rows = materialize(prints(docs), "prints")
    nodes = materialize(rows.groupBy("node").agg(F.min(F.struct("text_hash", "doc_id")).alias("one"), F.first("keys").alias("keys")), "nodes")
    roots = None
    for bands, whole in ((FIRST, False), (BANDS, True)):
        each = nodes.select("node", F.explode(F.slice("keys", 1, bands)).alias("key"))
        each = each.withColumn("root", F.col("node")) if roots is None else each.join(roots, "node", "left").select("node", "key", F.coalesce("root", "node").alias("root"))
        several = each.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", "n")
        own = each.join(several, "key")
        if not whole:
            own = own.withColumn("key", F.xxhash64("key", F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / PART))))
        else:  # any two parts of a large block meet in one task
            own = own.withColumn("parts", F.ceil(F.col("n") / CHUNK)).withColumn("part", F.pmod(F.xxhash64("node", "key"), F.col("parts")))
            own = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            own = own.withColumn("key", F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))))
        own = materialize(own.select("key", "node", "root"), "blocks")
        wanted = nodes.join(own.select("node").distinct(), "node", "left_semi").select("one.doc_id", "one.text_hash")
        sets = materialize(_sets(docs, wanted).groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("fp").alias("fp")), "sets")
        found = _linked(own.join(sets, "node").select("key", "node", "root", "shingles", "fp"))
        if roots is not None:
            found = found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = classes(found)
        drop_table(sets)
        drop_table(own)
    return rows.join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))
