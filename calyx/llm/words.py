"""Words and word shingles of many texts at once, as 64-bit hashes in flat arrays.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r.  Its hash is a
polynomial over random byte values, taken from prefix sums of the whole buffer,
and mixed.  Equal hashes stand for equal words; for two different ones that has
a chance of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from calyx.llm.common import row_slices

#: Text handled at once; smaller than elsewhere, as each byte takes some 60 bytes of working arrays.
WORD_SLICE = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(20_240_229)
_VALUE = _RANDOM.integers(1, 1 << 63, 256, np.uint64)
_PLACE = _RANDOM.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C55
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers under which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n and those of its inverse modulo 2**64; kept up to a slice's size."""
    if "up" in _POWERS and len(_POWERS["up"]) > n:
        return _POWERS["up"], _POWERS["down"]
    size = max(n + 1, WORD_SLICE * 5 // 4)
    up, down = (np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    if size <= WORD_SLICE * 2:
        _POWERS["up"], _POWERS["down"] = up, down
    return up, down


class Words:
    """Words of texts: `hash` of each, `text` it belongs to, and `first`[i]..`first`[i + 1] for those of text i."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts)
        data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        gap = np.r_[True, _SPACE[data], True]
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        if len(data):
            up, down = _powers(len(data))
            total = np.cumsum(_VALUE[data] * up[:len(data)])
            before = np.r_[np.uint64(0), total]
            raw = (before[self.end] - before[self.start]) * down[self.start]
            self.hash = mix(raw + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        else:
            self.hash = np.zeros(0, np.uint64)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.first = np.searchsorted(self.start, np.r_[0, np.cumsum(sizes)]).astype(np.int64)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.count)

    def shingles(self, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, first word) of every run of n words; with `short`, a text of fewer words has one, of all its words."""
        h = self.hash
        whole = max(0, len(h) - n + 1)
        total = np.zeros(whole, np.uint64)
        for j in range(n):
            total += h[j:j + whole] * _PLACE[j]
        inside = self.text[:whole] == self.text[n - 1:n - 1 + whole] if whole else np.zeros(0, bool)
        at = np.flatnonzero(inside)
        value, text = mix(total[at]), self.text[at]
        if short:
            few = np.flatnonzero((self.count > 0) & (self.count < n))
            if len(few):
                extra = np.zeros(len(few), np.uint64)
                for j in range(n - 1):
                    has = self.count[few] > j
                    extra[has] += h[self.first[few[has]] + j] * _PLACE[j]
                extra = mix(extra + self.count[few].astype(np.uint64))
                value, text, at = np.r_[value, extra], np.r_[text, few], np.r_[at, self.first[few]]
        return value, text, at


def word_batches(batches: Iterator[pa.RecordBatch], column: str, lower: bool = False) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Pieces of record batches with the words of their text column (null: none)."""
    for batch in batches:
        for piece in row_slices(batch, column, WORD_SLICE):
            yield piece, Words([t or b"" for t in piece.column(column).cast(pa.binary()).to_pylist()], lower)


def unique_in_text(text: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Indices of the distinct (text, keys...), in that order."""
    order = np.lexsort((*keys[::-1], text))
    if not len(order):
        return order
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in (text, *keys):
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order[new]


def per_text(n: int, text: np.ndarray) -> np.ndarray:
    """Offsets 0..n of sorted `text` numbers."""
    return np.searchsorted(text, np.arange(n + 1))
