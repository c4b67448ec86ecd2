"""Texts of an Arrow batch as flat arrays of bytes and words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BYTES_PER_CHUNK = 1_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of stretches of whole rows, of
    about BYTES_PER_CHUNK bytes each; a longer row is a stretch of its own."""
    if not len(column):
        return
    flat, offsets = text_bytes(column)
    cut = np.flatnonzero(np.diff(offsets[:-1] // BYTES_PER_CHUNK)) + 1
    edges = [0, *cut.tolist(), len(column)]
    for a, b in zip(edges[:-1], edges[1:]):
        yield a, b, flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for step in (_STEP, np.uint64(pow(int(_STEP), -1, 1 << 64))):
        steps = np.full(n, step, np.uint64)
        steps[0] = 1
        both.append(np.cumprod(steps, dtype=np.uint64))
    return both[0], both[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers_to(1 << max(20, int(n).bit_length()))
    return up[:n], down[:n]


def span_hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of every span."""
    up, down = powers(len(flat) + 1)
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64, out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each row and the number of words) of the runs without
    white space; no run crosses a row's border."""
    n = len(flat)
    solid = ~_SPACES[flat]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begin[inner] = solid[inner]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    stop[inner - 1] = solid[inner - 1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(stop) + 1, np.searchsorted(start, offsets)
