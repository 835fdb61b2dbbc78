"""Sums over keys of a corpus, moved between tasks as sorted arrays instead of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

FLUSH = 1 << 22
"""Distinct keys that a task holds before it sends them on."""


def pack(a: np.ndarray) -> bytes:
    """Bytes of an array, plane by plane: the high bytes of sorted keys and small counts then compress to little."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() if len(a) else b""


def unpack(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel() if raw else np.empty(0, dtype)


def add_up(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts. Sorted runs are merged, not sorted anew."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[at], np.diff(np.r_[at, len(keys)])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.add.reduceat(counts[order], at)


class Sums:
    """Adds up keys over the batches of a task."""

    def __init__(self, most: int = FLUSH) -> None:
        self.runs, self.size, self.most = [], 0, most

    def add(self, keys: np.ndarray) -> bool:
        """True if it is time to send."""
        self.runs.append(add_up(keys))
        self.size += len(self.runs[-1][0])
        if self.size > self.most and len(self.runs) > 1:
            self.runs = [self.take()]
            self.size = len(self.runs[0][0])
        return self.size > self.most

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate([r[i] for r in self.runs]) if self.runs else np.empty(0, kind) for i, kind in ((0, np.uint64), (1, np.int64)))
        self.runs, self.size = [], 0
        return add_up(keys, counts)


def blobs(keys, counts, part):
    """A record batch with a row for each part that has keys. Counts have four bytes, or eight where one needs them."""
    order = np.argsort(part, kind="stable")
    part, keys = part[order], keys[order]
    counts = counts[order].astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.uint64)
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, np.int64)
    to = np.r_[at[1:], len(part)]
    return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array([pack(keys[a:b]) for a, b in zip(at, to, strict=False)], pa.binary()), pa.array([pack(counts[a:b]) for a, b in zip(at, to, strict=False)], pa.binary())], names=["part", "keys", "counts"])


def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = [unpack(k.as_py(), np.uint64) for k in table.column("keys")]
    counts = [unpack(c.as_py(), np.uint64 if len(c.as_py()) > 4 * len(k) else np.uint32).astype(np.int64) for k, c in zip(keys, table.column("counts"), strict=True)]
    return add_up(np.concatenate(keys), np.concatenate(counts))
