"""Bytes of a batch of texts as NumPy arrays: cutting into tokens and hashing of all tokens at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PRIME = 0x9E3779B97F4A7C15 | 1
#: Bytes of text that are worked on together.
CHUNK = 1 << 20


@lru_cache(4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME**i and its inverse modulo 2**64, for i below n."""
    factors = np.full(n, PRIME, np.uint64)
    inverses = np.full(n, pow(PRIME, -1, 1 << 64), np.uint64)
    factors[0] = inverses[0] = 1
    up, down = np.cumprod(factors, dtype=np.uint64), np.cumprod(inverses, dtype=np.uint64)
    return up, down


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer: every bit of the result depends on every bit of h."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of data[begin:end] for each pair, whatever its place."""
    size = 1 << max(10, int(len(data)).bit_length())
    up, down = powers(size)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))
    return (sums[end] - sums[begin]) * down[begin]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about size bytes; a longer text is a run of its own. Null: empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
