"""Texts as small integer codes: lower-cased letters of a learned alphabet, one code for other letters, one for the rest."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np

SPACE = 0


class CodeTable:
    """Maps code points to classes: 0 for anything that is not a letter, 1.. for the alphabet, the last for other letters.

    Upper and lower case of a letter share a class. Picklable; the table over all code points is built on first use.
    """

    def __init__(self, alphabet: Iterable[str]):
        self.alphabet = "".join(dict.fromkeys(c for c in alphabet if len(c) == 1))
        self.size = len(self.alphabet) + 2
        self._table: np.ndarray | None = None

    @classmethod
    def learned(cls, texts: Iterable[str]) -> CodeTable:
        """All lower-case letters of the texts, the commonest first, ties by code point."""
        seen = Counter(c for t in texts for c in t.lower() if c.isalpha())
        return cls(c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])))

    def __getstate__(self):
        return {"alphabet": self.alphabet, "size": self.size, "_table": None}

    @property
    def table(self) -> np.ndarray:
        if self._table is None:
            t = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000).astype(np.uint8 if self.size < 256 else np.uint32) * (self.size - 1)
            for i, c in enumerate(self.alphabet, 1):
                for x in {c, c.upper(), c.lower()}:
                    if len(x) == 1:
                        t[ord(x)] = i
            self._table = t
        return self._table

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts end to end, runs of non-letters as one 0, each text led by a 0; and each text's first index (n + 1 values)."""
        lens = np.fromiter((len(t) + 1 if t else 1 for t in texts), dtype=np.int64, count=len(texts))
        raw = " ".join(["", *(t or "" for t in texts)]).encode("utf-32-le", "surrogatepass")
        codes = self.table[np.frombuffer(raw, dtype=np.uint32)]
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
        first = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(lens, out=first[1:])
        keep[first[:-1]] = True
        at = np.zeros(len(codes) + 1, dtype=np.int64)
        np.cumsum(keep, out=at[1:])
        return codes[keep], at[first]


def by_size(texts: list[str | None], chars: int = 1_500_000) -> Iterable[tuple[int, int]]:
    """Ranges of consecutive texts of about so many characters each; one long text is a range of its own."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > chars:
            yield start, i
            start, total = i, 0
        total += n + 1
    if start < len(texts):
        yield start, len(texts)


class Letters(CodeTable):
    """Codes are lower-case code points of letters and 0 for the rest, for any alphabet."""

    def __init__(self):
        self._table = None

    def __getstate__(self):
        return {"_table": None}

    @property
    def table(self) -> np.ndarray:
        if self._table is None:
            self._table = np.fromiter((ord(low) if (c := chr(i)).isalpha() and len(low := c.lower()) == 1 else ord(c) if c.isalpha() else 0 for i in range(0x110000)), dtype=np.uint32, count=0x110000)
        return self._table


#: Powers that name a word by its letters; longer words are cut into pieces of so many letters.
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, dtype=np.uint64))
#: Letters of a stem.
STEM = 5


def words(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of all words (runs of codes other than 0, cut at 64 letters) and then of the stems, the first STEM letters, of longer words; and the text each belongs to."""
    inside = codes != SPACE
    place = np.arange(len(codes))
    start = np.maximum.accumulate(np.where(inside, -1, place))  # of the space before; each text begins with one
    place = (place - start - 1) % len(_POWERS)
    begins = np.flatnonzero(inside & (place == 0))
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    part = np.where(inside, codes.astype(np.uint64) * _POWERS[place], np.uint64(0))
    text = np.searchsorted(first, begins, side="right") - 1
    longer = np.add.reduceat((inside & (place == STEM)).astype(np.int64), begins) > 0
    name = np.add.reduceat(part, begins)
    stem = np.add.reduceat(np.where(place < STEM, part, np.uint64(0)), begins)[longer] ^ np.uint64(0x5BD1E995)
    name = np.concatenate((name, stem))
    name ^= name >> np.uint64(29)
    return (name * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64), np.concatenate((text, text[longer]))
