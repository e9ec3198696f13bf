"""Language identification by rank-order profiles of n-grams.

Letters (with the marks that belong to them) are lower-cased, everything else is a blank, and a word is read with
one blank on either side. Its n-grams of 1 to 3 characters are counted, a lone blank isn't. A profile is the
PROFILE most frequent n-grams, equals in the order of their characters. A text's distance to a language is the
sum over the text's profile of how far each n-gram is out of place in the language's, PROFILE where it
isn't there; the nearest language is predicted, of equals the first in UTF-8 order. The score is
1 - distance / (PROFILE * n-grams in the text's profile).

* Training counts the n-grams of all given texts by language: an n-gram is one integer (three characters of 21
  bits), a task adds up sorted arrays and hands them out when they grow large, and Spark sums them. Only
  the PROFILE most frequent of each language reach the driver.
* Prediction broadcasts the profiles of LANGS languages at a time (7 MB), so the size of what is broadcast has a
  bound. With more languages, texts are profiled once, to a table, compared with each lot, and the nearest of
  all lots counts; the result is the same.
* A long text is counted in pieces that overlap by two characters.

Defined results: ``und`` and score 0 for a null text, one without a letter, and where nothing was learnt. Rows with a
null language, or without a doc_id that the split can go by, aren't crashes: the first are predicted only, and a
null doc_id counts as ''. Repeated rows each count and get a row each; an empty table gives no row. Bytes that
aren't valid UTF-8 are read as replacement characters, which are no letters. Other columns are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_value, materialize, prepare

PROFILE, LANGS = 300, 2000
UNKNOWN = "und"
#: Characters taken at a time, n-grams that a training task holds of all languages together.
PIECE, HELD = 1 << 19, 400_000
_BLANK = 32


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: what it is read as (lower case, or a blank), and whether it is a letter."""
    read, letter = np.full(0x110000, _BLANK, np.int64), np.zeros(0x110000, bool)
    for i in range(0x110000):
        c = chr(i)
        kind = unicodedata.category(c)[0]
        if kind in "LM":
            low = c.lower()
            read[i] = ord(low) if len(low) == 1 else i
            letter[i] = kind == "L"
    return read, letter


def _pieces(text: str) -> Iterator[tuple[np.ndarray, bool]]:
    """What the text's characters are read as, with a blank at either end of the text, PIECE and the two that
    follow at a time; and whether any is a letter."""
    read, letter = _characters()
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    for at in range(0, len(points) + 1, PIECE):
        own = points[max(at - 1, 0) : at + PIECE + 1]
        ends = [_BLANK] * (at == 0), [_BLANK] * (at + PIECE + 1 > len(points))
        yield np.concatenate((np.array(ends[0], np.int64), read[own], np.array(ends[1], np.int64))), bool(letter[own].any())


def grams(line: np.ndarray) -> np.ndarray:
    """The n-grams that begin in the first PIECE characters of a line, as integers in any order. Words that one blank
    parts share it, so an n-gram counts unless a blank is inside it or it is blank."""
    word = line != _BLANK
    one = line << 42
    two = one[:-1] | line[1:] << 21
    three = two[:-1] | line[2:]
    kept = word, word[:-1] | word[1:], word[1:-1]
    return np.concatenate([codes[:PIECE][mask[:PIECE]] for codes, mask in zip((one, two, three), kept)])


def add_up(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order with their summed counts."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
    return codes[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
    return codes[starts], np.diff(np.append(starts, len(codes)))


def counted(text: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """A text's n-grams with their counts, and whether it has a letter."""
    codes, counts, letters = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for line, any_letter in _pieces(text):
        more, n = _distinct(grams(line))
        codes, counts = add_up(np.concatenate((codes, more)), np.concatenate((counts, n))) if len(codes) else (more, n)
        letters |= any_letter
    return codes, counts, letters


def top(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The profile: the most frequent codes, equals in order."""
    return codes[np.argsort(-counts, kind="stable")[:PROFILE]]


def _decode(raw: bytes | None) -> str:
    return raw.decode("utf-8", "replace") if raw else ""


def learn(docs: DataFrame) -> DataFrame:
    """lang (binary), code and place (from 0) of each language's profile; rows with a null language are left out."""
    prepare(docs.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        fresh: dict[bytes, list[str]] = {}
        waiting = 0

        def fold() -> None:
            for lang, texts in fresh.items():
                codes, counts, _ = counted(" ".join(texts))
                if lang in held:
                    codes, counts = add_up(np.concatenate((held[lang][0], codes)), np.concatenate((held[lang][1], counts)))
                held[lang] = codes, counts
            fresh.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (codes, counts) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.binary()), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])
            held.clear()

        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = _decode(raw)
                fresh.setdefault(lang, []).append(text)
                waiting += len(text)
                if waiting > 4 * PIECE:
                    fold()
                    waiting = 0
                    if sum(len(c) for c, _ in held.values()) > HELD:
                        yield from out()
        fold()
        yield from out()

    rows = docs.where(docs["lang"].isNotNull()).select(docs["lang"].cast("string").cast("binary"), docs["text"].cast("string").cast("binary"))
    totals = rows.mapInArrow(step, "lang binary, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code")) - 1
    return totals.withColumn("place", place).where(F.col("place") < PROFILE).select("lang", "code", "place")


_PREDICTED = "row long, doc_id long, held_out boolean, distance long, n_grams long, lang binary"
_PROFILED = "row long, doc_id long, held_out boolean, profile binary"


def profile(docs: DataFrame) -> DataFrame:
    """Each text's profile as integers, null where it has no letter. ``row`` tells rows apart in a written table."""
    prepare(docs.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for raw in batch.column(2).to_pylist():
                codes, counts, letters = counted(_decode(raw))
                out.append(top(codes, counts).tobytes() if letters else None)
            rows = pa.array(np.arange(row, row + len(out)), pa.int64())
            row += len(out)
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["row", "doc_id", "held_out", "profile"])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), docs["text"].cast("string").cast("binary").alias("raw"))
    return own.mapInArrow(step, _PROFILED)


def nearest(profiles: DataFrame, lot) -> DataFrame:
    """The nearest language of a broadcast lot: names in UTF-8 order, and for each its codes in order with their places."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, langs = lot.value
        for batch in batches:
            distance, size, lang = [], [], []
            for raw in batch.column(3).to_pylist():
                own = np.frombuffer(raw or b"", np.int64)
                here, best = np.arange(len(own)), (None, None)
                for name, (codes, places) in zip(names, langs):
                    at = np.searchsorted(codes, own).clip(max=len(codes) - 1)
                    d = int(np.where(codes[at] == own, np.abs(places[at] - here), PROFILE).sum()) if len(own) else None
                    if d is not None and (best[0] is None or d < best[0]):
                        best = (d, name)
                distance.append(best[0])
                size.append(len(own))
                lang.append(best[1])
            arrays = [*batch.columns[:3], pa.array(distance, pa.int64()), pa.array(size, pa.int64()), pa.array(lang, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "held_out", "distance", "n_grams", "lang"])

    return profiles.mapInArrow(step, _PREDICTED)


def predict(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and distance (null for ``und``) of every row."""
    spark = docs.sparkSession
    kept = materialize(profiles, "langid-profiles")
    names = [bytes(r[0]) for r in kept.select("lang").distinct().orderBy("lang").toLocalIterator()]
    texts = profile(docs)
    lots = [names[i : i + LANGS] for i in range(0, len(names), LANGS)] or [[]]
    if len(lots) > 1:
        texts = materialize(texts, "langid-texts")
    found = []
    for lot in lots:
        by_lang: dict[bytes, list] = {name: [] for name in lot}
        for lang, code, place in (kept.where(F.col("lang").between(bytearray(lot[0]), bytearray(lot[-1]))).orderBy("lang", "code").collect() if lot else ()):
            by_lang[bytes(lang)].append((code, place))
        tables = [tuple(np.array(c, np.int64) for c in zip(*by_lang[name])) for name in lot]
        found.append(nearest(texts, broadcast_value(spark, (lot, tables))))
    out = found[0]
    if len(found) > 1:
        for more in found[1:]:
            out = out.unionByName(more)
        out = out.groupBy("row").agg(*(F.min_by(c, F.struct("distance", "lang")).alias(c) for c in ("doc_id", "held_out", "distance", "n_grams", "lang")))
    score = F.coalesce(1 - F.col("distance") / (PROFILE * F.col("n_grams")), F.lit(0.0))
    return out.select("doc_id", "held_out", F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"), "distance")


def identify(docs: DataFrame) -> DataFrame:
    """Profiles learnt from the rows that aren't held out, and a prediction for every row."""
    return predict(docs, learn(docs.where(~held_out(docs["doc_id"]))))
