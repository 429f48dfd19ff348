"""Vectorised hashing of words and shingles straight from Arrow's text buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D; those bytes
never occur inside a UTF-8 sequence, so bytes and code points split alike.  Word
hashes are polynomials over table values of the bytes, taken as differences of
one running sum over the batch and brought to a common offset by powers of the
inverse base; a final mixer spreads them.  No Python code runs per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def give_back() -> None:
    """Return freed memory to the system at the end of a task; workers live on and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


TABLE = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD6E8FEB86659FD93))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to ``n`` at least; the usual size is kept."""
    size = max(SLICE_BYTES, n) + 1
    if size in _powers:
        return _powers[size]
    out = []
    for b in (BASE, INVERSE):
        p = np.ones(size, np.uint64)
        done = 1
        while done < size:
            step = min(done, size - done)
            p[done : done + step] = p[:step] * U(pow(b, done, 1 << 64))
            done += step
        out.append(p)
    if size == SLICE_BYTES + 1:
        _powers[size] = (out[0], out[1])
    return out[0], out[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its values; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if offsets is not None and len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes together, or a single longer text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = last


def words(body: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the offsets of each text's words among them."""
    n = len(body)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if lower:
        body = LOWER[body]
    solid = ~SPACE[body]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(TABLE[body] * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * U(0xA24BAED4963EE407))
    return h, np.searchsorted(start, offsets)


def shingles(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text and their offsets, repeats included.

    A text of fewer words has one shingle, its whole sequence; one without words none.
    """
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    to = np.zeros(len(at), np.int64)
    np.cumsum(count, out=to[1:])
    if not len(h):
        return np.zeros(0, np.uint64), to
    place = np.repeat(at[:-1] - to[:-1], count) + np.arange(to[-1])
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    out = np.zeros(to[-1], np.uint64)
    for j in range(k):
        out = mix(out * U(0x9E3779B97F4A7C15) + padded[place + j] + U(j + 1))
    for i in np.flatnonzero((n > 0) & (n < k)):
        x = np.uint64(n[i])
        for w in h[at[i] : at[i + 1]]:
            x = mix(np.array([x * U(0xFF51AFD7ED558CCD) + w]))[0]
        out[to[i]] = x
    return out, to


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text and their offsets."""
    out, ends = [], np.zeros(len(at), np.int64)
    for i in range(len(at) - 1):
        v = np.sort(values[at[i] : at[i + 1]])
        if len(v) > 1:
            keep = np.empty(len(v), bool)
            keep[0] = True
            np.not_equal(v[1:], v[:-1], out=keep[1:])
            v = v[keep]
        out.append(v)
        ends[i + 1] = ends[i] + len(v)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), ends
