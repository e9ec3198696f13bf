"""Public tokenizers over whole texts, with the ids of recurring units kept.

Both tokenizers first split a text by a pattern and then merge within each part, so a text's ids are
the ids of its units in a row, wherever the cut between units is one that the pattern makes too. Plain
words go to the library's merges, other units to the library whole, and a bounded table keeps the ids
of what recurs; texts in which a cut is not plainly safe, or that may hold the text of an added token, go
to the library whole. Results are those of the library as it comes from the file, over the whole text.

Defined results: a null or empty text has no ids. Texts may be of any length; the table is bounded in
units and in bytes, and long units aren't kept.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
from tokenizers import Tokenizer

from .common import held

#: Units of a table, some 200 bytes each, and the length in bytes beyond which a unit isn't kept.
UNITS, LONGEST = 700_000, 32

#: A word of plain Latin letters, which no normalisation changes but for its case, with marks behind
#: it. Both tokenizers' patterns cut between the letters and the marks, as no apostrophe is among them.
_ENDS = (b",", b".")
_WORD = re.compile(rb"""( ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)""")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: printable Latin-1 as it is, the
    others from U+0100 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


_LETTERS = _byte_letters()
_BLANK = _LETTERS[32]


#: Second bytes of Latin letters with marks (the first is 0xC3): capitals to their small letters.
_SMALL = bytes(c + 32 if 0x80 <= c <= 0x9E else c for c in range(256))


class _Table(dict):
    """The ids of units; a unit asked for first is learnt. Units that end in a mark or a digit fill half of the
    table at most: the ids of a word and its marks are quickly put together, so what is left is for words. A full
    table learns without keeping, which costs less than to turn over what recurs, and begins anew once it has
    missed too often."""

    def __init__(self, learn, units: int = UNITS):
        super().__init__()
        self.learn, self.units, self.half, self.missed = learn, units, units // 2, 0

    def __missing__(self, unit: bytes) -> bytes:
        ids = self.learn(unit)
        if len(unit) <= LONGEST:
            if len(self) < self.half or unit[-1] >= 65 and len(self) < self.units:
                self[unit] = ids
            elif unit[-1] >= 65:
                self.missed += 1
        return ids

    def renew(self) -> None:
        if self.missed > 4 * self.units:
            self.clear()
            self.missed = 0


class _Tokens:
    #: Of an id in the bytes that stand for ids.
    type = "I"

    @classmethod
    def load(cls, path: str):
        """One table for a worker's whole life, or until another large one takes its place."""
        return held((cls.__name__, path), lambda: cls(path))

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        if self.library.get_vocab_size() > 1 << 8 * np.dtype(self.type).itemsize:
            raise ValueError(f"ids of {path} don't fit {self.type}")
        # what a text needs to hold the text of an added token: its first two characters
        self.marks = {t.content[:2].encode("utf-8") for t in self.library.get_added_tokens_decoder().values()}
        self.known = _Table(self.learn)

    def whole(self, raw: bytes) -> bytes:
        return array(self.type, self.library.encode(raw.decode("utf-8"), add_special_tokens=False).ids).tobytes()

    def parts(self, raw: bytes) -> list[bytes] | None:
        """The ids of the text's units, or None if it must be encoded whole."""
        raise NotImplementedError

    def letters(self, word: bytes) -> str:
        """A plain word as the library hands it to its merges."""
        raise NotImplementedError

    def learn(self, unit: bytes) -> bytes:
        """The ids of a unit not met before."""
        bare = unit[1:] if unit[0] == 32 else unit
        if bare.isalpha():  # ASCII letters
            word, marks = unit, b""
        elif unit[-1:] in _ENDS and bare[:-1].isalpha():
            word, marks = unit[:-1], unit[-1:]
        elif m := _WORD.fullmatch(unit):
            word, marks = m.groups()
        else:
            return self.whole(unit)
        if marks:
            return self.of(word) + self.of(marks)
        return array(self.type, [t.id for t in self.model.tokenize(self.letters(word))]).tobytes()

    def of(self, unit: bytes) -> bytes:
        return self.known[unit]

    def encode(self, raws: list[bytes | None]) -> list[bytes]:
        """The ids of each text, as numbers of ``type``."""
        out = []
        for raw in raws:
            parts = [] if not raw else None if any(mark in raw for mark in self.marks) else self.parts(raw)
            out.append(self.whole(raw) if parts is None else b"".join(parts))
            self.known.renew()
        return out


class WordTokens(_Tokens):
    """Lower-casing word tokenizer: white space only separates, so a text is cut at ASCII white space."""

    type = "H"

    def parts(self, raw: bytes) -> list[bytes]:
        return list(map(self.known.__getitem__, raw.lower().split()))

    def learn(self, unit: bytes) -> bytes:
        if unit.isalpha():  # ASCII letters
            return array("H", [t.id for t in self.model.tokenize(unit.decode("latin-1"))]).tobytes()
        return super().learn(unit)

    def letters(self, word: bytes) -> str:
        if word.isascii():
            return word.decode("latin-1")
        # bytes beyond ASCII that print in Latin-1 stand for themselves
        return word.translate(_SMALL).decode("latin-1").replace("\x9f", _LETTERS[0x9F]).replace("\xa0", _LETTERS[0xA0]).replace("\xad", _LETTERS[0xAD])


#: Bytes of white space beyond blank and line feed, ASCII or not: such texts are encoded whole.
_ODD_ASCII = b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_ODD = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80\x80", b"\xef\xbb\xbf")
_CUT = re.compile(rb"(?<=[^ \n])(?=[ \n][^ \n])")


class ByteTokens(_Tokens):
    """Byte-level tokenizer: a blank belongs to the word after it. A text is cut before a single blank
    or line feed that stands between two other characters; the pattern cuts there as well. Units with
    a blank before them are known without it; those with none, or several, have a table of their own."""

    def __init__(self, path: str):
        super().__init__(path)
        self.known = _Table(self.behind, UNITS // 2)  # ids of 32 bits, and a pipeline's worker has more to hold
        self.bare = _Table(self.learn, UNITS // 4)

    def behind(self, unit: bytes) -> bytes:
        """The ids of a unit with the blank, or the line feed that it begins with, before it."""
        if unit[0] != 10:
            return self.learn(b" " + unit)
        return self.of(b"\n") + self.of(unit[1:]) if len(unit) > 1 else self.learn(unit)

    def of(self, unit: bytes) -> bytes:
        if len(unit) > 1 and unit[1] not in b" \n":
            if unit[0] == 32:
                return self.known[unit[1:]]
            if unit[0] == 10:  # a line feed before a word is a part of its own
                return self.known[unit]
        return self.bare[unit]

    def parts(self, raw: bytes) -> list[bytes] | None:
        if len(raw.translate(None, _ODD_ASCII)) < len(raw) or any(x in raw for x in _ODD):
            return None
        self.bare.renew()
        if b"  " in raw or b" \n" in raw or b"\n " in raw or b"\n\n" in raw or raw[:1] in b" \n" or raw[-1:] in b" \n":
            return list(map(self.of, _CUT.split(raw)))
        units = raw.replace(b"\n", b" \n").split(b" ")
        parts = list(map(self.known.__getitem__, units))
        parts[0] = self.of(units[0])
        return parts

    def letters(self, word: bytes) -> str:
        text = word.decode("latin-1")
        return text.replace(" ", _BLANK) if text.isascii() else text.translate(_LETTERS)


__all__ = ["ByteTokens", "WordTokens"]
