"""Vectorised words, word hashes and word-window hashes of whole Arrow text batches.

A word is a maximal run of bytes other than the ASCII white space 09-0D and 20.
Hashes are 64-bit polynomials modulo 2**64, made from prefix sums, so that a
window's hash costs O(1) whatever its length, and are finalised by a bit mixer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import string_buffers

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd bases of the polynomials: bytes of a word, words of a window (two independent ones).
BYTE_BASE, WORD_BASE, WORD_BASE_2 = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95), U(0xA0761D6478BD642F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = U(pow(int(base), -1, 1 << 64))
        have = tuple(np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, b, U), dtype=U)]) for b in (base, inverse))
        if size <= 1 << 22:
            _powers[int(base)] = have
    return have


#: Terms: words split at every ASCII byte that is no letter or digit, ASCII case folded.
_NO_TERM = np.array([not (chr(i).isalnum() or i >= 128) for i in range(256)])
_FOLD = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


class Words:
    """Words (or terms) of a batch: byte spans [start, end), and per document the range of its words."""

    def __init__(self, texts: pa.Array, terms: bool = False):
        data, off = string_buffers(texts)
        self.data, self.off = (_FOLD[data] if terms else data), off
        space = (_NO_TERM if terms else _SPACE)[data]
        word = ~space
        filled = np.flatnonzero(off[1:] > off[:-1])
        first = word.copy()
        first[1:] &= space[:-1]
        begin = off[filled]
        first[begin] = word[begin]
        last = word
        begin_end = off[filled + 1] - 1
        tail = last[begin_end].copy()
        last = last.copy()
        last[:-1] &= space[1:]
        last[begin_end] = tail
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc_at = np.searchsorted(self.start, off)
        self.count = np.diff(self.doc_at)

    def hashes(self, stems: tuple[int, ...] = ()) -> np.ndarray:
        """A hash of each word; with ``stems``, a row more for each length: the hash of the
        word's first so many bytes, 0 for words that are no longer."""
        forward, back = powers(BYTE_BASE, len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, U)
        np.cumsum((self.data.astype(U) + U(1)) * forward[: len(self.data)], out=sums[1:])
        whole = mix((sums[self.end] - sums[self.start]) * back[self.start])
        if not stems:
            return whole
        rows = [whole]
        for k in stems:
            longer = self.end - self.start > k
            to = np.where(longer, self.start + k, self.start)
            rows.append(np.where(longer, mix(((sums[to] - sums[self.start]) * back[self.start]) ^ U(0x9216D5D98979FB1B + k)), U(0)))
        return np.stack(rows)


class WindowHash:
    """Hashes of any word window [at, at + length) of a sequence of word hashes."""

    def __init__(self, words: np.ndarray, base: np.uint64 = WORD_BASE):
        self.forward, self.back = powers(base, len(words) + 1)
        self.sums = np.zeros(len(words) + 1, U)
        np.cumsum(words * self.forward[: len(words)], out=self.sums[1:])

    def at(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[at + length] - self.sums[at]) * self.back[at])


def starts_within(count: np.ndarray, doc_at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions at which a window of k words of one document starts, and their documents."""
    n = np.maximum(count - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    return np.repeat(doc_at[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()), doc


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each document: (hashes, occurrences, len+1 offsets).
    A shorter document with words has one shingle, of all its words; without words, none."""
    words = Words(texts)
    h = WindowHash(words.hashes())
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    at, doc = starts_within(words.count, words.doc_at, k)
    value = np.concatenate([h.at(at, k), h.at(words.doc_at[short], words.count[short])])
    doc = np.concatenate([doc, short])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(value)))
    return value[first], times, np.searchsorted(doc[first], np.arange(len(words.count) + 1))


def term_hash(terms: list[str]) -> np.ndarray:
    """Sorted hashes of single terms."""
    return np.unique(Words(pa.array(terms, pa.string()), terms=True).hashes())
