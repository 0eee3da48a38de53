"""Counting hashes: merged in the map tasks, shipped packed by hash slice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .vectors import U64

PACKED = "slice int, once binary, more binary, count binary"


class Tally:
    """Counts by hash, merged as they come, handed on before they get large."""

    def __init__(self, most: int):
        self.most, self.parts, self.size = most, [], 0

    def add(self, h: np.ndarray) -> None:
        u, n = np.unique(h, return_counts=True)
        self.parts.append((u, n))
        self.size += len(u)

    def full(self) -> bool:
        if self.size > 2 * self.most:
            self.parts = [self.take(keep=True)]
            self.size = len(self.parts[0][0])
        return self.size > self.most

    def take(self, keep: bool = False) -> tuple[np.ndarray, np.ndarray]:
        h = np.concatenate([p[0] for p in self.parts])
        n = np.concatenate([p[1] for p in self.parts])
        if len(self.parts) > 1:
            order = np.argsort(h, kind="stable")
            h, n = h[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            h, n = h[first], np.add.reduceat(n, first)
        if not keep:
            self.parts, self.size = [], 0
        return h, n


def split_slices(h: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Slice number (rising with the hash) and 32 more bits.

    Slices grow in number with the data, so the two together tell hashes apart
    alike at every size.
    """
    high = (h >> U64(32)) * U64(slices)
    return (high >> U64(32)).astype(np.int64), ((high & U64(0xFFFFFFFF)) ^ (h & U64(0xFFFFFFFF))).astype(np.uint32)


def pack_counts(h: np.ndarray, n: np.ndarray, slices: int) -> pa.RecordBatch:
    """One row for each slice: hashes counted once, the others and their counts."""
    part, low = split_slices(h, slices)
    cut = np.searchsorted(part, np.arange(slices + 1))
    rows = []
    for s in np.flatnonzero(np.diff(cut)):
        a, b = cut[s], cut[s + 1]
        one = n[a:b] == 1
        rows.append((int(s), low[a:b][one].tobytes(), low[a:b][~one].tobytes(), n[a:b][~one].astype(np.uint32).tobytes()))
    columns = list(zip(*rows)) or [[], [], [], []]
    types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["slice", "once", "more", "count"])


def unpack_counts(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 32-bit hashes of one slice and their summed counts."""
    read = lambda c: np.frombuffer(b"".join(x.as_py() for x in rows.column(c)), np.uint32)
    once, more = read("once"), read("more")
    low = np.concatenate([once, more])
    n = np.concatenate([np.ones(len(once), np.int64), read("count").astype(np.int64)])
    order = np.argsort(low, kind="stable")
    low, n = low[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    return low[first], np.add.reduceat(n, first)
