"""Compact arrays for the n-gram trie: bit-packed integers, Elias-Fano pointers, mapped from disk.

All reads are vectorised: they take an array of indices and work on numpy arrays that may be
memory-mapped.
"""

from __future__ import annotations

import tempfile
from pathlib import Path

import numpy as np

U64 = np.uint64


def _gather_or(at: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """n words, each the OR of the values whose (ascending) index it is."""
    out = np.zeros(n, U64)
    if len(at):
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[at[first]] = np.bitwise_or.reduceat(value, first)
    return out


class Packed:
    """Unsigned integers of a fixed number of bits."""

    def __init__(self, values: np.ndarray, bits: int):
        values = values.astype(U64)
        self.bits, self.n = bits, len(values)
        start = np.arange(self.n, dtype=np.int64) * bits
        word, off = start >> 6, (start & 63).astype(U64)
        n = (self.n * bits >> 6) + 2
        self.words = _gather_or(word, values << off, n)
        over = np.flatnonzero(off.astype(np.int64) + bits > 64)
        self.words |= _gather_or(word[over] + 1, values[over] >> (U64(64) - off[over]), n)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        start = i.astype(np.int64) * self.bits
        word, off = start >> 6, (start & 63).astype(U64)
        out = self.words[word] >> off
        over = off > 0
        high = np.where(over, self.words[word + 1] << ((U64(64) - off) & U64(63)), U64(0))
        return (out | high) & U64((1 << self.bits) - 1) if self.bits < 64 else out | high


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary with a popcount directory."""

    def __init__(self, values: np.ndarray):
        values = values.astype(U64)
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.low_bits = max(0, (top // max(1, self.n)).bit_length() - 1)
        self.low = Packed(values & U64((1 << self.low_bits) - 1), self.low_bits) if self.low_bits else None
        at = (values >> U64(self.low_bits)).astype(np.int64) + np.arange(self.n)
        self.words = _gather_or(at >> 6, U64(1) << (at & 63).astype(U64), (int(at[-1]) >> 6) + 1 if self.n else 1)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.before, i, "right") - 1
        left = i - self.before[word]
        bits, at = np.array(self.words[word]), word << 6
        for s in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(bits & U64((1 << s) - 1)).astype(np.int64)
            past = left >= count
            left = np.where(past, left - count, left)
            bits = np.where(past, bits >> U64(s), bits)
            at = np.where(past, at + s, at)
        high = (at - i).astype(np.int64) << self.low_bits
        return high if self.low is None else high | self.low[i].astype(np.int64)


SCALE = 4096


def quantise(x: np.ndarray) -> np.ndarray:
    """Codes of logarithms of probabilities (at most 0, at least -250), on a square-root scale: finest near 0."""
    return np.rint(np.sqrt(-np.minimum(x, 0.0)) * SCALE).astype(np.uint16)


def restore(code: np.ndarray) -> np.ndarray:
    return -((code.astype(np.float64) / SCALE) ** 2)


class Level:
    """One level of a trie: for each parent a run of children, ascending, each with quantised values.

    counts: number of children of each parent; child: their word numbers; values: named arrays
    aligned with child.  A child is found by a successor search inside its parent's run.
    """

    def __init__(self, counts: np.ndarray, child: np.ndarray, n_words: int, **values: np.ndarray):
        self.pointers = EliasFano(np.concatenate([[0], np.cumsum(counts)]))
        self.child = Packed(child, max(1, int(n_words - 1).bit_length() if n_words else 1))
        self.codes = {name: quantise(x) for name, x in values.items()}

    def find(self, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Position of each (parent, child), -1 where either is absent (parent -1: absent)."""
        known = np.flatnonzero(parent >= 0)
        out = np.full(len(parent), -1, np.int64)
        lo, end = self.pointers[parent[known]], self.pointers[parent[known] + 1]
        want, hi = child[known].astype(U64), end.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.child[mid] < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        at = np.flatnonzero(lo < end)
        hit = self.child[lo[at]] == want[at]
        out[known[at[hit]]] = lo[at[hit]]
        return out


class Mapped:
    """Moves the arrays of levels to files that are mapped back in; the files go with the context."""

    def __enter__(self) -> Mapped:
        self._dir = tempfile.TemporaryDirectory(prefix="trie-")
        self._n = 0
        return self

    def __exit__(self, *_: object) -> None:
        self._dir.cleanup()

    def array(self, x: np.ndarray) -> np.ndarray:
        path = Path(self._dir.name) / f"{self._n}.npy"
        self._n += 1
        if not len(x):
            return x
        np.save(path, x)
        return np.load(path, mmap_mode="r")

    def level(self, level: Level) -> Level:
        level.child.words = self.array(level.child.words)
        level.pointers.words = self.array(level.pointers.words)
        level.pointers.before = self.array(level.pointers.before)
        if level.pointers.low is not None:
            level.pointers.low.words = self.array(level.pointers.low.words)
        level.codes = {k: self.array(v) for k, v in level.codes.items()}
        return level
