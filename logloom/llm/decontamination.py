r"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is words (ASCII letters lower-cased; every other ASCII byte that is not a digit
separates).  A pattern is a window of ``window`` consecutive words of a benchmark item, or a
whole shorter item.  Patterns of one length m form one matcher:

* the shift table maps a block of two adjacent words to how far the search may move when the
  block ends at the present position; blocks of no pattern move m - 1 words at once;
* a block that ends some pattern has shift 0, and its suffix bucket lists the patterns that
  end in it;
* each listed pattern is compared word by word before it counts.

A document is searched whole and in place, so nothing is shuffled but one row of hits for each
document.  Patterns are split into blocks of items of about ``block_bytes`` of text (2 MB make
tables of some 200 MB); each block is one bounded closure and one narrow pass that carries the hits
found so far.  A Python worker builds a block's tables once and keeps them for its later tasks.

Defined results: a null or empty text has no words and no hits; items without words have no
window; two items with the same window both count; an item without an id hits words but is no item
of n_items and the ids; rows that share an item id are one item; repeated document rows are judged
one by one; very long texts are searched whole; an empty table gives an empty result; columns other
than the id and the text are not read by ``judge`` and pass ``keep_clean`` unchanged.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table, unused
from .wordhash import LOWER

WINDOW, BLOCK_BYTES = 10, 2 << 20
_TO_WORD = bytearray(LOWER)
for _c in range(128):
    if not (48 <= _c <= 57 or 65 <= _c <= 90 or 97 <= _c <= 122):
        _TO_WORD[_c] = 32
_TO_WORD = bytes(_TO_WORD)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORD).split() if text else []


class WuManber:
    """All patterns of one length m >= 1, each a tuple of words with its items."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], list[int]]):
        self.m, self.block = m, min(2, m)
        self.far = m - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for pattern, items in patterns.items():
            for j in range(self.block, m + 1):
                key = pattern[j - 1] if self.block == 1 else (pattern[j - 2], pattern[j - 1])
                self.shift[key] = min(self.shift.get(key, self.far), m - j)
            self.bucket.setdefault(key, []).append((list(pattern), items))

    def find(self, text: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """Start and items of each occurrence."""
        m, far, n, shift, bucket = self.m, self.far, len(text), self.shift, self.bucket
        pairs = self.block == 2
        at = m - 1
        while at < n:
            key = (text[at - 1], text[at]) if pairs else text[at]
            step = shift.get(key, far)
            if step:
                at += step
                continue
            start = at - m + 1
            for pattern, items in bucket[key]:
                if text[start : at + 1] == pattern:
                    yield start, items
            at += 1


def compile_items(items: Iterable[tuple[int, str | None]], window: int = WINDOW) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            found = by_length.setdefault(m, {}).setdefault(tuple(w[i : i + m]), [])
            if item not in found:
                found.append(item)
    return [WuManber(m, p) for m, p in sorted(by_length.items())]


_built: dict[str, list[WuManber]] = {}


def _matchers(key: str, block: list[tuple[int, str | None]], window: int) -> list[WuManber]:
    """The tables of a block, built once in each worker; it keeps those of the last few blocks."""
    if key not in _built:
        while len(_built) >= 2:
            del _built[next(iter(_built))]
        _built[key] = compile_items(block, window)
    return _built[key]


def _item_blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, str | None]]]:
    """Items in groups of about block_bytes of text, one group at the driver at a time."""
    total = items.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    n = int(total // block_bytes) + 1
    part = F.pmod(F.xxhash64(item_col, text_col), F.lit(n))
    for k in range(n):
        rows = items.select(item_col, text_col).where(part == k).collect() if n > 1 else items.select(item_col, text_col).collect()
        yield [(r[0], r[1]) for r in rows]


def _hits(docs: DataFrame, items: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int, block_bytes: int) -> DataFrame:
    """docs with a column of hits (each occurrence's start and length, int32 pairs) and one of the item ids found."""
    hit, found = _marks(docs)
    out = docs.withColumns({hit: F.lit(b"").cast("binary"), found: F.array().cast("array<string>")})
    schema, at = out.schema, out.columns.index(text_col)
    for block in _item_blocks(items, item_col, item_text_col, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], key=uuid.uuid4().hex, block=block) -> Iterator[pa.RecordBatch]:
            matchers = _matchers(key, block, window)
            for b in batches:
                spans, found = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
                for i, text in enumerate(b.column(at)):
                    w = words(text.as_py())
                    hit: list[int] = []
                    seen: dict[int, None] = {}
                    for matcher in matchers:
                        for start, ids in matcher.find(w):
                            hit += (start, matcher.m)
                            seen.update(dict.fromkeys(ids))
                    if hit:
                        spans[i] += np.array(hit, np.int32).tobytes()
                        found[i] = [*found[i], *(str(x) for x in seen if x is not None)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(spans, pa.binary()), pa.array(found, pa.list_(pa.string()))], names=b.schema.names)

        out = out.mapInArrow(run, schema)
    return out


def _covered(spans: bytes, n: int) -> np.ndarray:
    """Which of n words lie inside an occurrence."""
    edges = np.zeros(n + 1, np.int64)
    at = np.frombuffer(spans, np.int32).reshape(-1, 2)
    np.add.at(edges, at[:, 0], 1)
    np.add.at(edges, at[:, 0] + at[:, 1], -1)
    return np.cumsum(edges[:-1]) > 0


def judge(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: id, n_words, n_hit, n_items, items (sorted as strings), hit_spans (start, length in words), contaminated."""
    found = _hits(docs.select(id_col, text_col), items, text_col, item_col, item_text_col, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_hit, ids, spans = [], [], [], []
            for text, hit, items_ in zip(b.column(1), b.column(2), b.column(3)):
                n = len(words(text.as_py()))
                mask = np.diff(np.concatenate([[False], _covered(hit.as_py(), n), [False]]).astype(np.int8))
                starts, ends = np.flatnonzero(mask == 1), np.flatnonzero(mask == -1)
                n_words.append(n)
                n_hit.append(int((ends - starts).sum()))
                ids.append(sorted(set(items_.as_py())))
                spans.append([{"start": int(s), "words": int(e - s)} for s, e in zip(starts, ends)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))), pa.array([x > 0 for x in n_hit])],
                names=[id_col, "n_words", "n_hit", "n_items", "items", "hit_spans", "contaminated"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return found.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items array<string>, hit_spans array<struct<start:int,words:int>>, contaminated boolean")


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows without any occurrence, all columns unchanged."""
    found = _hits(docs, items, text_col, item_col, item_text_col, window, block_bytes)
    hit, items_found = _marks(docs)
    return found.where(F.octet_length(hit) == 0).drop(hit, items_found)


def _marks(docs: DataFrame) -> tuple[str, str]:
    return unused(docs.columns, "__hit"), unused(docs.columns, "__items")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


QUERIES = {"op5_decontamination": op5_decontamination}

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = rf"regexp_extract_all(translate(coalesce(text, ''), '{_A}', '{_Z}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = {
    "op5_decontamination": rf"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
b AS (SELECT item_id, {_SPLIT} AS w FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
ms AS (SELECT DISTINCT m FROM pat),
win AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM d, ms, unnest(range(1, len(w) - m + 2)) AS u(i) WHERE len(w) >= m),
hit AS (SELECT doc_id, win.m, i, item_id FROM win JOIN pat ON win.m = pat.m AND win.g = pat.g),
cover AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, m, i FROM hit), unnest(range(i, i + m)) AS u(k) GROUP BY doc_id),
it AS (SELECT doc_id, count(s) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN it USING (doc_id)"""
}
