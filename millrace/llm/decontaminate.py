"""Benchmark decontamination with one Aho-Corasick automaton over the test items.

A text becomes its words: ASCII letters (lower-cased) and digits and every character beyond
ASCII; all else separates. A *window* is WIDTH consecutive words of an item, or all words of a
shorter one. A document word is hit if it lies in an occurrence of a window.

Any run of WIDTH = 2 * SEED words holds a whole aligned piece of SEED words, so the automaton has
those pieces (and the short items) only: its size follows the items' text and not WIDTH times it. The text
is scanned once. A piece found may lie at any of WIDTH - SEED + 1 places of a window; the document's
windows around it, each looked at once, are looked up word by word in a table of all items' windows, so nothing
rests on a hash. The work on a text grows with its words, however repetitive it or the items are.

What is found is mapped back to the original text, in code points.

An automaton holds AUTOMATON_BYTES of items, which bounds what is broadcast and what workers hold. A larger
benchmark is taken in groups, one after the other: the documents' texts are written once and scanned once
for each group, and what the groups find is joined.

Defined results: a null or empty text has no words and no hit; an item without words matches
nothing; items of equal text are all reported; an item without item_id hits but is not counted or named;
repeated rows are each judged; texts of any length are scanned whole; what touches or overlaps is one hit;
an empty benchmark leaves every document clean; an empty table gives no rows. Other columns of either
table are ignored (``scan``) or kept (``drop_contaminated``).
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_value, doc_columns, held, materialize, prepare, rows_by_key, text_hash

WIDTH = 10
#: Words of an aligned piece: every window of WIDTH words holds at least one.
SEED = WIDTH // 2
#: Bytes of item text in one automaton (about 80 times that in memory).
AUTOMATON_BYTES = 4 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")

SPANS = "array<struct<item_id:string,word_start:int,word_end:int,char_start:int,char_end:int>>"
HITS = "array<struct<word_start:int,word_end:int,char_start:int,char_end:int>>"
_HIT = [("word_start", pa.int32()), ("word_end", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32())]
_SPANS_TYPE, _HITS_TYPE = pa.list_(pa.struct([("item_id", pa.string()), *_HIT])), pa.list_(pa.struct(_HIT))


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(_FOLD).split() if raw else []


class Matcher:
    """The automaton of some items, and the stretches of a text that their windows cover."""

    def __init__(self, items: list[tuple[str | None, bytes | None]]):
        self.names: list[str | None] = []
        self.window: dict[bytes, int] = {}
        self.holders: list[list[int]] = []  # the items that have the window of that number
        seeds: set[bytes] = set()
        short: dict[bytes, list[int]] = defaultdict(list)
        for item_id, raw in items:
            words = words_of(raw)
            if not words:
                continue
            at = len(self.names)
            self.names.append(item_id)
            if len(words) < WIDTH:
                short[b" ".join(words)].append(at)
                continue
            seeds.update(b" ".join(words[k : k + SEED]) for k in range(0, len(words) - SEED + 1, SEED))
            for k in range(len(words) - WIDTH + 1):
                number = self.window.setdefault(b" ".join(words[k : k + WIDTH]), len(self.holders))
                if number == len(self.holders):
                    self.holders.append([at])
                elif self.holders[number][-1] != at:
                    self.holders[number].append(at)
        self.machine = ahocorasick.Automaton()
        for seed in seeds | set(short):
            number = -1
            if seed in short:
                number = len(self.holders)
                self.holders.append(short[seed])
            key = f" {seed.decode('latin-1')} "
            self.machine.add_word(key, (len(key), seed.count(b" ") + 1, number, seed in seeds))
        if self.names:
            self.machine.make_automaton()

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(window's number, first word, word after the last), each once."""
        if not self.names or not words:
            return
        text = (b" " + b" ".join(words) + b" ").decode("latin-1")
        spaces = tried = None
        for end, (size, n, number, piece) in self.machine.iter(text):
            if spaces is None:
                spaces = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
                tried = bytearray(len(words))
            at = int(np.searchsorted(spaces, end - size + 1))
            if number >= 0:
                yield number, at, at + n
            if piece:
                for start in range(max(0, at - WIDTH + SEED), min(at, len(words) - WIDTH) + 1):
                    if not tried[start]:
                        tried[start] = 1
                        found = self.window.get(b" ".join(words[start : start + WIDTH]))
                        if found is not None:
                            yield found, start, start + WIDTH

    def runs(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(item, first word, word after the last) of every stretch that an item's windows cover."""
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for number, lo, hi in self.occurrences(words):
            places[number].append((lo, hi))
        if not places:
            return []
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for number, spans in places.items():
            for item in self.holders[number]:
                found[item] += spans
        return sorted((lo, hi, item) for item, spans in found.items() for lo, hi in joined(spans))

    def hit(self, words: list[bytes]) -> bool:
        return next(self.occurrences(words), None) is not None


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open spans, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def char_spans(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs' places in the original text, in code points."""
    spans = [m.span() for m in _WORD.finditer(raw.decode("utf-8"))]
    return [(spans[lo][0], spans[hi - 1][1]) for lo, hi in runs]


def hits_of(spans: list[dict]) -> list[dict]:
    """What spans of any items cover together."""
    place = {s["word_start"]: s["char_start"] for s in spans} | {-s["word_end"]: s["char_end"] for s in spans}
    return [{"word_start": lo, "word_end": hi, "char_start": place[lo], "char_end": place[-hi]} for lo, hi in joined([(s["word_start"], s["word_end"]) for s in spans])]


def _matcher(handle) -> Matcher:
    """One automaton lives in a Python worker at a time."""
    key, items = handle.value
    return held(("Matcher", key), lambda: Matcher(items))


def _groups(benchmark: DataFrame, limit: int) -> tuple[int, Iterator]:
    """How many groups of about ``limit`` bytes the items make, and the groups as broadcasts, one at a time."""
    own = benchmark.select(benchmark["item_id"].cast("string").alias("item_id"), benchmark["text"].cast("string").cast("binary").alias("raw"))
    count = max(1, -(-(own.agg(F.sum(F.length("raw"))).first()[0] or 0) // limit))

    def each():
        for g in range(count):
            part = own if count == 1 else own.where(F.pmod(F.xxhash64("item_id", "raw"), F.lit(count)) == g)
            items = [(r[0], bytes(r[1]) if r[1] is not None else None) for r in part.collect()]
            yield broadcast_value(benchmark.sparkSession, (hashlib.sha256(repr(items).encode()).hexdigest(), items))

    return count, each()


def _spans(matcher: Matcher, raw: bytes | None) -> tuple[int, list[dict]]:
    words = words_of(raw)
    runs = matcher.runs(words)
    places = char_spans(raw, [r[:2] for r in runs]) if runs else []
    return len(words), [{"item_id": matcher.names[i], "word_start": lo, "word_end": hi, "char_start": a, "char_end": b} for (lo, hi, i), (a, b) in zip(runs, places)]


def scan(docs: DataFrame, benchmark: DataFrame, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """doc_id, text_hash, n_words, spans (what each item's windows cover) and hits (what all cover together),
    with their places in words and in code points of the original text, in order."""
    count, groups = _groups(benchmark, automaton_bytes)
    own = doc_columns(docs, text_hash(docs).alias("text_hash"))
    names = ["doc_id", "text_hash", "n_words", "spans", "hits"]
    prepare(docs.sparkSession)

    if count == 1:
        handle = next(groups)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(handle)
            for batch in batches:
                found = [_spans(matcher, raw) for raw in batch.column(1).to_pylist()]
                arrays = [batch.column(0), batch.column(2), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], _SPANS_TYPE), pa.array([hits_of(s) if s else [] for _, s in found], _HITS_TYPE)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

        return own.mapInArrow(step, f"doc_id long, text_hash long, n_words long, spans {SPANS}, hits {HITS}")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            counts = [len(words_of(raw)) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(np.arange(row, row + len(counts)))], names=["doc_id", "raw", "text_hash", "n_words", "row"])
            row += len(counts)

    base = materialize(own.mapInArrow(number, "doc_id long, raw binary, text_hash long, n_words long, row long"), "texts")
    found = None
    for handle in groups:

        def step(batches: Iterator[pa.RecordBatch], handle=handle) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(handle)
            for batch in batches:
                spans = [_spans(matcher, raw)[1] for raw in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS_TYPE)], names=["row", "spans"]).filter(pa.array([bool(s) for s in spans], pa.bool_()))

        part = materialize(base.select("row", "raw").mapInArrow(step, f"row long, spans {SPANS}"), "spans")
        handle.unpersist()
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [sorted(s or [], key=lambda x: (x["word_start"], x["word_end"], x["item_id"] or "")) for s in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, _SPANS_TYPE), pa.array([hits_of(s) for s in spans], _HITS_TYPE)], names=names)

    return base.drop("raw").join(found, "row", "left").select("doc_id", "text_hash", "n_words", "spans").mapInArrow(join, f"doc_id long, text_hash long, n_words long, spans {SPANS}, hits {HITS}")


def summarise(scanned: DataFrame) -> DataFrame:
    """One row for each document: words, hit words, items, their digest, the verdict, and the hits' places
    in the text as start:end, comma-joined."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["word_end"] - h["word_start"])
    items = F.array_sort(F.array_distinct(F.filter(F.transform("spans", lambda s: s["item_id"]), lambda i: i.isNotNull())))
    places = F.transform("hits", lambda h: F.concat_ws(":", h["char_start"].cast("string"), h["char_end"].cast("string")))
    return scanned.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.array_join(places, ",").alias("places"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The documents without any hit, with all their columns."""
    prepare(docs.sparkSession)
    count, groups = _groups(benchmark, automaton_bytes)
    if count > 1:
        scanned = materialize(scan(docs, benchmark, automaton_bytes).select("doc_id", "text_hash", F.size("hits").alias("n")), "scanned")
        return rows_by_key(docs, scanned.where("n > 0").select("doc_id", "text_hash").distinct(), matching=False).select("row.*")
    handle, at = next(groups), docs.columns.index("text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(handle)
        for batch in batches:
            raws = batch.column(at).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([not matcher.hit(words_of(raw)) for raw in raws], pa.bool_()))

    return docs.mapInArrow(step, docs.schema)
