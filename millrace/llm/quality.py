"""Quality rules: base counts of each text, and lines that recur across a host's documents.

Lines are normalised (ASCII letters lower-cased, white space runs made one blank) and hashed. For
each host the *distinct documents* that contain a line are counted, each once however often it repeats
the line; documents of equal text are one. A line is boilerplate, and is removed, above the host's limit:
SHARE of the host's distinct documents, but MIN_DOCS at least and MAX_DOCS at most, so that a large host
keeps no line that thousands of documents share. A document is *depleted* and rejected if less than KEEP
of its words remain.

Near copies are distinct documents, so a group of them larger than the limit makes its own lines
boilerplate. Callers who want to keep such groups for a later step give ``copies``, a class for each
text; then documents of one class count once (and one document alone is a class).

Hot hosts are no burden: counts are pre-aggregated per task and dealt by host and line. Lines above
the limit are a small written table, which Spark broadcasts only if its size allows.

Defined results: a null text has no words and no lines and fails the base rule, an empty one
likewise; a null host is a host of its own; repeated rows are each judged, and alike; texts of any length
are taken whole, one at a time; a count equal to the limit keeps the line, and exactly KEEP keeps the
document; an empty table gives no rows; other columns are ignored (``judge``) or kept (``apply``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_value, doc_columns, materialize, rows_by_key, same, text_hash

MIN_WORDS, MIN_DOCS, MAX_DOCS, SHARE, KEEP = 50, 10, 1000, 0.01, 0.2
_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(c for c in range(256) if c not in _SYMBOLS)
_TAIL = bytes(range(128, 192))  # UTF-8 bytes that start no character


def line_key(line: bytes) -> int:
    """64 bits of the normalised line's MD5, as a signed long."""
    return int.from_bytes(hashlib.md5(b" ".join(line.lower().split()), usedforsecurity=False).digest()[:8], "big", signed=True)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) < 1 << 21:
        windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:  # too many words to pack three in a long: number the pairs first
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * len(number) + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    equal = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(windows), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + len(windows)] |= twice
    return int(hit.sum())


def measure(raw: bytes | None) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line keys, words of the lines."""
    words = raw.split() if raw else []
    if not words:
        return 0, 0, 0, 0, 0, [], []
    chars = len(b"".join(words).translate(None, _TAIL))
    lines = [line for line in raw.split(b"\n") if not line.isspace() and line]
    duplicates = len(lines) - len(set(lines))
    return len(words), chars, len(raw.translate(None, _NOT_SYMBOLS)), duplicates, repeated_words(words), [line_key(x) for x in lines], [len(x.split()) for x in lines]


_MEASURED = "doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, keys array<long>, sizes array<int>, row long"


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """Base counts and line keys of every row, with a number that is unique to the row."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            found = [measure(raw) for raw in batch.column(1).to_pylist()]
            columns = list(zip(*found)) if found else [[]] * 7
            arrays = [batch.column(0), batch.column(2), batch.column(3), *(pa.array(c, pa.int64()) for c in columns[:5])]
            arrays += [pa.array(columns[5], pa.list_(pa.int64())), pa.array(columns[6], pa.list_(pa.int32())), pa.array(np.arange(row, row + len(found)))]
            row += len(found)
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _MEASURED.split(", ")])

    own = doc_columns(docs, docs[host].cast("string").alias("host"), text_hash(docs).alias("text_hash"))
    return own.mapInArrow(step, _MEASURED)


def _spot(host: str, key: str) -> Column:
    """One number for a line on a host."""
    return F.xxhash64(host, key)


def frequent_lines(rows: DataFrame, min_docs: int = MIN_DOCS, max_docs: int = MAX_DOCS, share: float = SHARE, copies: DataFrame | None = None) -> DataFrame:
    """spot and docs of the lines above their host's limit; a spot is a line's key and its host."""
    own = rows.where(F.size("keys") > 0).groupBy("host", "text_hash").agg(F.first("keys").alias("keys"))  # equal texts have equal lines
    if copies is None:
        votes = own.withColumn("copy", F.col("text_hash"))
    else:
        votes = own.join(copies.groupBy("text_hash").agg(F.min("root").alias("copy")), "text_hash")
    limit = F.least(F.lit(float(max_docs)), F.greatest(F.lit(float(min_docs)), share * F.count_distinct("copy")))
    limits = materialize(votes.groupBy("host").agg(limit.alias("limit")), "limits")
    votes = votes.select("host", "copy", F.explode(F.array_distinct("keys")).alias("key"))
    if copies is not None:
        votes = votes.distinct()
    votes = votes.alias("v").join(limits.alias("h"), same(F.col("v.host"), F.col("h.host"))).select("v.host", "limit", "key")
    return votes.groupBy(_spot("host", "key").alias("spot")).agg(F.count("*").alias("docs"), F.max("limit").alias("limit")).where("docs > limit").select("spot", "docs")


def judge(docs: DataFrame, host: str = "source", keep: float = KEEP, **limits) -> DataFrame:
    """Every row's counts, the words and keys of its lines above the limit, and the verdict. ``limits``
    are those of frequent_lines; ``copies`` there: text_hash and root (the class) of every row."""
    rows = materialize(measured(docs, host), "lines")
    frequent = materialize(frequent_lines(rows, **limits), "frequent")
    lines = rows.select("row", "host", F.explode(F.arrays_zip("keys", "sizes")).alias("line")).select("row", _spot("host", "line.keys").alias("spot"), "line.keys", "line.sizes")
    hits = lines.join(frequent, "spot", "left_semi")
    removed = hits.groupBy("row").agg(F.sum("sizes").alias("n_removed"), F.collect_set("keys").alias("removed"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = rows.drop("keys", "sizes").join(removed, "row", "left").withColumns({"n_removed": F.coalesce("n_removed", F.lit(0)), "base_failed": failed})
    # in whole numbers: less than keep of the words remain
    depleted = 1000 * (F.col("n_words") - F.col("n_removed")) < round(1000 * keep) * F.col("n_words")
    return out.withColumn("kept", ~failed & ~depleted)


#: Boilerplate lines that are broadcast at most (some 30 MB); more are joined to their documents.
BROADCAST_LINES = 500_000


def apply(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The kept documents with all their columns, their boilerplate lines removed; n_chars, if there,
    follows the text. Verdicts meet the texts by doc_id, text and host, on which alone they depend."""
    place = F.xxhash64("text_hash", "host")
    verdicts = materialize(judge(docs, host, **limits).select("doc_id", place.alias("text_hash"), "host", "kept", "removed"), "verdicts")
    own_place = F.xxhash64(text_hash(docs), docs[host].cast("string"))
    kept = rows_by_key(docs, verdicts.where("not kept").select("doc_id", "text_hash").distinct(), matching=False, hashed=own_place)
    touched = verdicts.where("kept and removed is not null")
    spots = materialize(touched.select("host", F.explode("removed").alias("key")).distinct(), "spots")
    names = docs.columns
    at, size, by = names.index("text"), names.index("n_chars") if "n_chars" in names else None, names.index(host)
    if spots.count() <= BROADCAST_LINES:
        by_host: dict[str | None, set[int]] = {}
        for h, key in spots.collect():
            by_host.setdefault(h, set()).add(key)
        handle = broadcast_value(docs.sparkSession, by_host)
        rows = kept.select("row.*")
    else:
        handle = None
        each = touched.groupBy("doc_id", "text_hash").agg(F.first("removed").alias("removed"))
        rows = kept.join(each, same(F.col("id"), F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left").select("row", "removed")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns if handle is not None else batch.column(0).flatten())
            if handle is not None:
                drop = [handle.value.get(h) for h in columns[by].cast(pa.string()).to_pylist()]
            else:
                drop = [set(keys) if keys else None for keys in batch.column(1).to_pylist()]
            if any(drop):
                old = columns[at].to_pylist()
                new = [without(t, keys) if keys else t for t, keys in zip(old, drop)]
                columns[at] = pa.array(new, columns[at].type)
                if size is not None:
                    columns[size] = pa.array([n if a == b else len(b) for n, a, b in zip(columns[size].to_pylist(), old, new)], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(step, docs.schema)


def without(text: str, keys: set[int]) -> str:
    """The text without the lines of those keys."""
    return "\n".join(x for x in text.split("\n") if x.isspace() or not x or line_key(x.encode("utf-8")) not in keys)

