"""Secret scans: keyword automaton first, anchored expressions only at its hits, then checksums.

Kinds, in the order that breaks ties of place:

* ``assign``: a keyword, an equals sign or colon and a value of six characters or more;
* ``access``: ``AKIA`` and capitals or digits, 20 characters or more;
* ``hex``: a run of 24 or more lower-case hexadecimal digits;
* ``github`` and ``npm``: a prefixed token of 36 base-62 characters, the last six of which are the
  CRC-32 of the first 30;
* ``card``: 13 to 19 digits, or four groups of four that blanks or hyphens part, whose last digit is the Luhn
  checksum of the others.

Of the last three kinds a candidate whose checksum fails is not reported; ``scan`` counts them.

An Aho-Corasick automaton over the lower-cased bytes finds the keywords; a compiled expression is
then tried at each hit and nowhere else. Hits are taken from the left and a hit inside the match
before it is skipped, which gives the leftmost non-overlapping matches of a full scan, as each
expression starts with one of its keywords. Runs of digits have no keyword: bytes are mapped to
"digit or not" and 24 digits in a row are searched for; so are four decimal digits in a row, where the
expression of cards is tried unless a digit stands before them.

Defined results: a null or empty text has no spans; repeated rows are each scanned; other columns
are ignored (``scan``) or kept (``redact``). Places are in code points, ends exclusive; in bytes that aren't valid
UTF-8 each one that doesn't continue a character counts as one, and ``redact`` leaves them as they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, prepare

KINDS = ("assign", "access", "hex", "github", "npm", "card")
BASE = 3
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: What redact() puts in a secret's place.
MASK = "[SECRET]"

_ASSIGN = re.compile(rb"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_GITHUB = re.compile(rb"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
_NPM = re.compile(rb"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
_KEYWORDS = [("password", 0), ("passwd", 0), ("secret", 0), ("token", 0), ("apikey", 0), ("api_key", 0), ("akia", 1), ("ghp_", 3), ("gho_", 3), ("ghu_", 3), ("ghs_", 3), ("ghr_", 3), ("npm_", 4)]
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_RUN = b"h" * MIN_HEX
_CARD = re.compile(rb"(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?!\d)")
_DECIMAL = bytes(100 if chr(c) in "0123456789" else 32 for c in range(256))

_MACHINE = ahocorasick.Automaton()
for _word, _kind in _KEYWORDS:
    _MACHINE.add_word(_word, (len(_word), _kind))
_MACHINE.make_automaton()


def checksum62(body: bytes) -> str:
    """The six base-62 characters of a body's CRC-32, highest first."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = _BASE62[digit] + out
    return out


def _valid(token: bytes) -> bool:
    return checksum62(token[:30]) == token[30:].decode("ascii")


def luhn(digits: bytes) -> bool:
    """Whether every second digit from the right doubled, and all added up by their own digits, give a multiple of ten."""
    numbers = [d - 48 for d in reversed(digits)]
    return (sum(numbers[::2]) + sum(2 * d - 9 * (d > 4) for d in numbers[1::2])) % 10 == 0


def find_bytes(raw: bytes | None) -> tuple[list[tuple[int, int, int]], int]:
    """(start, kind, end) of all spans of a UTF-8 text, in bytes, in order, and how many candidates failed their checksum."""
    if not raw:
        return [], 0
    spans: list[tuple[int, int, int]] = []
    hits = sorted((end - size + 1, kind) for end, (size, kind) in _MACHINE.iter(raw.lower().decode("latin-1")))
    last, refused = [0] * len(KINDS), 0
    for at, kind in hits:
        if at < last[kind]:
            continue
        if m := (_ASSIGN, _ACCESS, None, _GITHUB, _NPM)[kind].match(raw, at):
            last[kind] = m.end()
            if kind == 0 and len(m[1]) >= MIN_VALUE or kind == 1 and m.end() - at >= MIN_ACCESS or kind > 1 and _valid(m[1]):
                spans.append((at, kind, m.end()))
            elif kind > 1:
                refused += 1
    digits = raw.translate(_HEX)
    at = digits.find(_RUN)
    while at >= 0:
        end = digits.find(b" ", at)
        end = len(digits) if end < 0 else end
        spans.append((at, 2, end))
        at = digits.find(_RUN, end)
    digits = raw.translate(_DECIMAL)
    at = digits.find(b"dddd")
    while at >= 0:
        end = digits.find(b" ", at)
        end = len(digits) if end < 0 else end
        if m := _CARD.match(raw, at):
            end = m.end()
            if luhn(m[0].translate(None, b" -")):
                spans.append((at, 5, end))
            else:
                refused += 1
        at = digits.find(b"dddd", end)
    spans.sort()
    return spans, refused


def _characters(raw: bytes) -> int:
    """Code points: bytes that don't continue one."""
    return len(raw) if raw.isascii() else int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def find(raw: bytes | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, in code points, in order. The text is gone through once."""
    return _in_characters(raw, find_bytes(raw)[0])


def _in_characters(raw: bytes | None, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or raw.isascii():
        return spans
    place, at, n = {}, 0, 0
    for p in sorted({x for a, _, b in spans for x in (a, b)}):
        n += _characters(raw[at:p])
        place[p] = n
        at = p
    return [(place[a], k, place[b]) for a, k, b in spans]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of kind, start, end, ordered by start and kind) and n_refused: candidates whose checksum failed."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(raw, *find_bytes(raw)) for raw in batch.column(1).to_pylist()]
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in _in_characters(raw, spans)] for raw, spans, _ in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS), pa.array([n for *_, n in rows], pa.int64())], names=["doc_id", "spans", "n_refused"])

    return doc_columns(docs).mapInArrow(step, "doc_id long, spans array<struct<kind:string,start:int,end:int>>, n_refused long")


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def summarise(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:BASE]))
    return scanned.select("doc_id", *(count(k) for k in KINDS[:BASE]), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"), "n_refused")


def masked_bytes(raw: bytes) -> bytes:
    """The text with MASK in place of each stretch that some span covers."""
    out, last = [], 0
    for a, _, b in find_bytes(raw)[0]:
        if a >= last:
            out += [raw[last:a], MASK.encode()]
        last = max(last, b)
    return b"".join(out) + raw[last:]


def masked(text: str | None) -> str | None:
    return masked_bytes(text.encode("utf-8")).decode("utf-8") if text else text


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns, with secrets masked in ``text`` and n_chars, if there, brought up to
    date where the text changed."""
    prepare(docs.sparkSession)
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            old = columns[at].cast(pa.binary()).to_pylist()
            new = [masked_bytes(t) if t else t for t in old]
            texts = pa.array(new, pa.binary())
            columns[at] = pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), texts.null_count)  # as they are: bytes needn't be valid
            if size is not None:
                columns[size] = pa.array([n if a == b else _characters(b) for n, a, b in zip(columns[size].to_pylist(), old, new)], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(step, docs.schema)

