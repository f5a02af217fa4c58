"""Vectorised word splitting and hashing of Arrow text batches.

Every operator that works on words shares this module.  A batch of texts is seen as one
byte buffer; word boundaries, word hashes and n-gram hashes are computed with a fixed
number of numpy passes, so the cost per word does not depend on Python.

Words are maximal runs of bytes that are not in the separator table, and never cross a
text's border.  Hashes are 64 bits wide; two different n-grams share one with probability
2**-64, which every caller treats as equality of the n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_Q = U64(0xC2B2AE3D27D4EB4F)
PIECE = 1 << 20

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACES = b" \t\n\x0b\x0c\r"
BLANK = np.zeros(256, bool)
BLANK[list(SPACES)] = True

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept per process and grown on demand."""
    key = f"{base}"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, PIECE + 1)
        have = np.full(size, U64(base), U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[bytes, np.ndarray]:
    """The texts' UTF-8 bytes joined without separators, and len+1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return b"", np.zeros(1, np.int64)
    raw = column.buffers()[2]
    raw = raw.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if raw is not None else b""
    return (raw.translate(LOWER) if lower else raw), offsets - offsets[0]


def word_spans(raw: bytes, offsets: np.ndarray, separator: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words of each text."""
    data = np.frombuffer(raw, np.uint8)
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    inside = ~separator[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    border = offsets[1:-1]
    border = border[(border > 0) & (border < len(data))]
    first[border] = inside[border]
    last[border - 1] = inside[border - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; works piecewise, so memory is a few PIECEs."""
    out = np.empty(len(starts), U64)
    data = np.frombuffer(raw, np.uint8)
    at = 0
    while at < len(starts):
        lo = starts[at]
        to = max(int(np.searchsorted(ends, lo + PIECE, "right")), at + 1)
        hi = ends[to - 1]
        n = int(hi - lo)
        total = np.zeros(n + 1, U64)
        np.cumsum((data[lo:hi].astype(U64) + U64(1)) * _power(_P, n), out=total[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix((total[e] - total[s]) * _power(_P_INV, n + 1)[s] + (e - s).astype(U64))
        at = to
    return out


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes, by its first word; len(words) - n + 1 of them."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    total = words[:m].copy()
    for k in range(1, n):
        total = total * _Q + words[k : k + m]
    return mix(total)


def slices(batch: pa.RecordBatch, size: str, most_bytes: int = 4 * PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about most_bytes of the text column; one row at least."""
    column = batch.column(batch.schema.get_field_index(size)).cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(int(np.searchsorted(ends, ends[at] + most_bytes, "right")) - 1, at + 1)
        yield batch.slice(at, to - at)
        at = to
