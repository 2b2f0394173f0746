"""Texts as flat arrays of code points: character classes, words, and hashes of any stretch, all by numpy passes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

SPACE, LETTER, NUMBER, OTHER, END = range(5)
#: One past the last code point; stands after each text.
MARK = 0x110000
_ODD = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point by Unicode's letter, number and white-space properties."""
    points = np.r_[0:0xD800, 0xE000:0x110000]
    every = "".join(map(chr, points))
    table = np.full(MARK + 1, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[points[m.start() : m.end()]] = kind
    table[MARK] = END
    return table


@lru_cache(maxsize=1)
def lowered() -> np.ndarray:
    """Lower case of each code point that has one of a single code point."""
    table = np.arange(MARK + 1, dtype=np.uint32)
    for c in range(MARK):
        if not 0xD800 <= c < 0xE000 and len(low := chr(c).lower()) == 1:
            table[c] = ord(low)
    return table


@lru_cache(maxsize=1)
def noise() -> np.ndarray:
    """A fixed random 64-bit number for each code point."""
    return np.random.default_rng(20240229).integers(1, 1 << 64, MARK + 1, dtype=np.uint64)


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd number and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Grid:
    """Code points of some texts, each followed by MARK. starts, ends: of each text, without its MARK."""

    def __init__(self, texts: list[str]):
        joined = "\0".join(texts) + "\0"
        self.cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.cp[self.ends] = MARK
        self.kind = classes()[self.cp]
        self.text = joined

    def hashes(self, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
        """Hashes of stretches; equal stretches have equal ones wherever they stand. fold: case is ignored."""
        up, down = powers(len(self.cp))
        value = noise()[lowered()[self.cp] if fold else self.cp]
        value *= up
        total = np.empty(len(value) + 1, np.uint64)
        total[0] = 0
        np.cumsum(value, out=total[1:])
        return mixed((total[ends] - total[starts]) * down[starts])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of letters and numbers, and how many each text has."""
        inside = (self.kind == LETTER) | (self.kind == NUMBER)
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        starts, ends = edge[::2], edge[1::2]
        upto = np.searchsorted(starts, self.ends)
        return starts, ends, np.diff(upto, prepend=0)
