"""Vectorised scanning of UTF-8 text in Arrow batches with numpy.

A batch is cut into slices of about ``SLICE`` bytes of whole texts, so temporary arrays stay bounded
by the longest text. Words are runs of bytes of one class; every byte of a non-ASCII code point is
0x80 or above, so byte classes equal code point classes whenever non-ASCII is in or out as a whole.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 4 << 20
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


class _Cache(dict):
    """Travels empty: each worker fills its own."""

    def __reduce__(self):
        return _Cache, ()


_POWERS = _Cache()


def _classes(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


ALNUM = _classes((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LETTER = _classes((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
SPACE = _classes((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keyed(seed: int, n: int) -> np.ndarray:
    """n pseudo-random uint64 that depend on the seed alone."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed & MASK))


#: one random value per byte; upper and lower case ASCII letters share theirs in the folded table
EXACT = keyed(11, 256)
FOLDED = EXACT[LOWER]


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        step = np.full(size, base & MASK, np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if size <= 4 * SLICE:
            _POWERS[base] = have
    return have[:n]


INVERSE = pow(BASE, -1, 1 << 64)


def release() -> None:
    """Hands memory that numpy and Arrow have freed back to the system: a worker goes on to other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def texts(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of slices of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + size, "right")) - 1)
        yield i, data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        i = j


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the runs of bytes for which ``inside`` holds; run ``first[i]`` is the
    first at or after text i's start, so text i has runs first[i] .. first[i + 1]."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    at = offsets[:-1][full]
    start[at] = inside[at]
    at = offsets[1:][full] - 1
    end[at] = inside[at]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = FOLDED) -> np.ndarray:
    """A 64-bit hash of every run: a polynomial over the bytes' random values, then a finaliser."""
    prefix = prefix_sums(data, values)
    return span_hashes(prefix, starts, ends)


def prefix_sums(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    back = powers(INVERSE, len(prefix))
    return mixed((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words (positions 0 .. n - width)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out *= np.uint64(BASE)
        out += words[j : j + n]
    return mixed(out + np.uint64(width))


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte position (length n + 1)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
