"""Terms of many texts at once: maximal runs of ASCII letters and digits and of all characters beyond ASCII.

Only A-Z are lower-cased.  Work is done on UTF-8 bytes: every byte of a
character beyond ASCII is 0x80 or more, so the runs are those of characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from calyx.llm.common import row_slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Text handled at once inside a task.
TERM_SLICE = 1 << 20

_IN_TERM = np.zeros(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _IN_TERM[_low:_high + 1] = True


class Terms:
    """Terms of texts: `start` and `end` in `data` (lower-cased; every byte outside of terms is a space), and `text`, the text each belongs to."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" " + b" ".join(texts).lower() + b" ", np.uint8)
        inside = _IN_TERM[raw]
        self.data = np.where(inside, raw, np.uint8(0x20))
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        begins = np.cumsum([1, *[len(t) + 1 for t in texts]])[:-1]
        self.text = np.searchsorted(begins, self.start, "right") - 1
        self.n_texts = len(texts)

    def per_text(self) -> np.ndarray:
        """Number of terms of each text."""
        return np.bincount(self.text, minlength=self.n_texts)


def text_bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def term_batches(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, Terms]]:
    """Pieces of record batches with the terms of their text column (null: none)."""
    for batch in batches:
        for piece in row_slices(batch, column, TERM_SLICE):
            yield piece, Terms(text_bytes(piece.column(column)))
