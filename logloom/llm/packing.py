"""Compact blobs of integer columns, for exchanges whose rows would otherwise be single numbers.

A column (a rising one as its differences) is split into byte planes (all lowest bytes, then
all second bytes, ...) and compressed.  Sorted 64-bit hashes then cost little more than the
information they hold.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

_LEVEL = 1


def pack(*columns: np.ndarray) -> bytes:
    """Integer columns of any lengths as one blob."""
    parts, lengths = [], []
    for c in columns:
        c = np.ascontiguousarray(c)
        if c.dtype != np.uint64:
            c = c.astype(np.int64).view(np.uint64)
        d, rising = c.copy(), bool((c[1:] >= c[:-1]).all())
        if rising:
            d[1:] -= c[:-1]
        planes = d.view(np.uint8).reshape(-1, 8)
        used = 8
        while used and not planes[:, used - 1].any():
            used -= 1
        parts.append(planes[:, :used].T.tobytes())
        lengths += [len(c), used, rising]
    head = np.array([len(columns), *lengths], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=_LEVEL).compress(head + b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    """The columns as uint64; view as int64 where they were signed."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    lengths = raw[8 : 8 + 24 * n].view(np.int64).reshape(n, 3)
    at, out = 8 + 24 * n, []
    for size, used, rising in lengths:
        full = np.zeros((size, 8), np.uint8)
        full[:, :used] = raw[at : at + size * used].reshape(used, size).T
        at += size * used
        column = full.reshape(-1).view(np.uint64)
        out.append(np.cumsum(column, dtype=np.uint64) if rising else column)
    return out


def ranked(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A column of few distinct numbers as (table, places), the most frequent number at place 0."""
    values, inverse, count = np.unique(column, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return values[order], place[inverse]


def release() -> None:
    """Give freed memory back to the system: a worker that waits for its next task then holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(f: Callable) -> Callable:
    """A function of one group that releases memory when it is done."""

    def run(group):
        out = f(group)
        release()
        return out

    return run


def tidy_batches(f: Callable) -> Callable:
    """A function of batches that releases memory after each batch it yields and at its end."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for out in f(batches):
            yield out
            del out
            release()
        release()

    return run
