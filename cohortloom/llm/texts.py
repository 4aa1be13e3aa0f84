"""Numpy over the bytes of many texts at once: slices of a batch, words and their hashes."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_GOLDEN = 0x9E3779B97F4A7C15


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins and the last ends; null is the empty text."""
    column = column.fill_null("") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(offsets) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of ``most`` bytes in all (or one longer text), ``rows`` texts at most."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(n, at + rows, max(to, at + 1))
        yield at, to
        at = to


def lowered(data: np.ndarray) -> np.ndarray:
    """A copy with A-Z in lower case."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text number of every word ``[^\\x20\\x09-\\x0D]+``; no word crosses texts."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not((data == 32) | ((data >= 9) & (data <= 13)), out=inside[1:-1])
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begin = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return begin, end, np.searchsorted(offsets, begin, "right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x2545F4914F6CDD1D
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_GOLDEN))


def spans_hash(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes (or code points) of each span: equal ones have equal hashes wherever they stand.

    A polynomial over random values of the bytes, modulo 2**64, from prefix sums.
    """
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = SLICE_BYTES if len(data) < SLICE_BYTES else 1 << (len(data)).bit_length()
    up, down = _powers(size + 1)
    values = _BYTE[data] if data.dtype == np.uint8 else mixed(data.astype(np.uint64) * np.uint64(_GOLDEN) + np.uint64(7))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values * up[: len(data)], out=sums[1:])
    return mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(_GOLDEN))


def runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for ``length[0]`` numbers, then the same for each further run."""
    total = np.cumsum(length)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - length), length)

