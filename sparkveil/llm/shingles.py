"""Hashed word shingles of whole texts, and set comparison on sorted hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_LOWER = bytes.maketrans(bytes([*range(65, 91), *range(9, 14)]), bytes([*range(97, 123), *[32] * 5]))
#: Bytes of a text whose words are held as objects at once.
PIECE = 1 << 18
_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


class _Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 100_000:
                self.clear()
            self[word] = h
        return h


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _words(text: str) -> Iterator[list[bytes]]:
    """The words of a text, in pieces of about PIECE bytes that end where a word does."""
    raw = text.encode().translate(_LOWER)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


class Shingler:
    """Sets of hashed word shingles: A-Z lower-cased, words parted by ASCII white space.

    A text with fewer than ``size`` words has the whole sequence as its one shingle; one without words
    has none. With ``framed`` size - 1 empty words stand before and after a text with words. Hashes are 64
    bits; two shingles of one document collide with a chance of about n^2 / 2^65.
    """

    def __init__(self, size: int, framed: bool = False):
        self.size, self.words = size, _Hashes()
        self.frame = np.full(size - 1 if framed else 0, xxhash.xxh64_intdigest(b""), np.uint64)

    def hashes(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes, as uint64."""
        parts = [np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words)) for words in _words(text or "")]
        h = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        if not len(h):
            return h
        h = np.concatenate([self.frame, h, self.frame])
        n = min(self.size, len(h))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - n + 1, np.uint64(n))
            for k in range(n):
                out = (out ^ (out >> np.uint64(29))) * _ODD[k % 4] + h[k : len(h) - n + 1 + k]
        return np.unique(mix(out))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
