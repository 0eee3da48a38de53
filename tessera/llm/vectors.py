"""Vectorised words, shingles and hashes over Arrow batches (numpy)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.default_rng(20240131)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(int(_BASE), -1, 2**64))
_MULT = _rng.integers(1, 2**63, 16, dtype=np.uint64) * U64(2) + U64(1)
_power = np.ones(1, U64)
_inverse = np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n."""
    global _power, _inverse
    if len(_power) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("_power", _BASE), ("_inverse", _BASE_INV)):
            a = np.full(size, base, U64)
            a[0] = 1
            globals()[name] = np.cumprod(a)
    return _power[:n], _inverse[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread hashes over all 64 bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each have about ``limit`` bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        if not len(sizes):
            continue
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row and the n + 1 offsets; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """s with s[j] - s[i] = the polynomial hash of data[i:j] times base ** i."""
    power, _ = powers(len(data) + 1)
    s = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=s[1:])
    return s


def words(
    data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _BLANK, lower: np.ndarray = _LOWER
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document index, start and end of every ASCII-lower-cased word."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none, none
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = ~blank[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    s = prefix_hash(lower[data])
    _, inverse = powers(n + 1)
    h = mix((s[end] - s[start]) * inverse[start] + (end - start).astype(U64))
    doc = np.searchsorted(offsets, start, side="right") - 1
    return h, doc, start, end


def word_bounds(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Where the words of each document begin; n_docs + 1 numbers."""
    return np.searchsorted(doc, np.arange(n_docs + 1))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashed k-word shingles of each document.

    A document of fewer than k words has one shingle, its whole sequence;
    without words it has none.
    """
    h, doc, _, _ = words(data, offsets)
    bounds = word_bounds(doc, len(offsets) - 1)
    m = max(0, len(h) - k + 1)
    g = np.zeros(m, U64)
    for j in range(k):
        g += h[j : j + m] * _MULT[j]
    g = mix(g)
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            total = (h[a:b] * _MULT[: b - a]).sum(dtype=U64) + U64(int(b - a))
            out.append(mix(np.array([total], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def long_column(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == U64 else values.astype(np.int64))
