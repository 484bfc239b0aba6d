"""Bitmaps of hashed keys, of bounded size, to leave out early what a join would leave out later."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from calyx.llm.words import mix

#: At least 2**17 bits, 16 for each key, up to this many (16 MB); beyond that callers take another way.
BITS_MOST = 1 << 27
SLICE_BITS = 1 << 17


def bitmap_bits(n: int) -> int:
    return max(SLICE_BITS, 1 << max(1, 16 * n - 1).bit_length())


def bit_of(key: np.ndarray, bits: int) -> np.ndarray:
    return (mix(key.view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def key_bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap with the bit of each key (the one long column of `keys`); slices are made in tasks, so the driver gets `bits` bits at most."""
    (name,) = keys.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = bit_of(frame[name].to_numpy(np.int64), bits)
            yield pd.DataFrame({"slice": at // SLICE_BITS, "bit": at % SLICE_BITS})

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(SLICE_BITS, np.uint8)
        flags[part["bit"].to_numpy()] = 1
        return pd.DataFrame({"slice": [key[0]], "data": [np.packbits(flags, bitorder="little").tobytes()]})

    slices = keys.mapInPandas(run, "slice long, bit long").groupBy("slice").applyInPandas(pack, "slice long, data binary").collect()
    whole = np.zeros(bits // 8, np.uint8)
    for row in slices:
        whole[row["slice"] * SLICE_BITS // 8:(row["slice"] + 1) * SLICE_BITS // 8] = np.frombuffer(row["data"], np.uint8)
    return whole


def has_bit(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
