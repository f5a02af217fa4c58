r"""Substring deduplication by hashing lines and their clauses.

A text is cut at line ends, and a line after each sentence end or comma, semicolon or colon before a
blank (ideographic sentence ends need no blank), into units.  Units are
normalised (case folded, blanks collapsed) and digested with 128 bits.  Digests are grouped
globally; of each group the earliest occurrence, by (document id, offset), stays.  The others
are repeated units.  A line whose units are all repeated goes whatever its length (or from
``min_line_words`` on).  Within other lines every run of neighbouring repeated units with ``min_words`` words or more is removed.  So a
repeated line or paragraph goes, and a long one also where it was pasted into a longer line,
while a short phrase inside a line of its own stays.  Units of fewer than ``min_unit_words``
words only go inside a run or with their line, never at a run's ends.  For both limits a unit has
as many words as blanks part, or one for each six characters besides blanks if that is more, so
scripts without blanks are measured too; ``words`` of a span counts by blanks alone.

Exchanges carry packed blobs (see packing.py).  Within a block of documents all but the
earliest occurrence of a digest are settled at once, so a line that a third of all documents
share is one entry for each block.  The texts move once, to meet their documents' decisions.

Defined results: null and empty texts stay as they are; rows with a null id stay as they are and
take no part; rows that share an id are one document given repeatedly and get the same
decisions; a text may become empty but its row stays; very long texts are cut up whole; an empty
table gives an empty result; columns besides the text are unchanged, whatever their names, but with
spans a column ``removed`` of the input gives way to the spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import pack, tidy, tidy_batches, unpack
from .tables import shards_for, table, unused
from .wordhash import U64, mix, slices

MIN_WORDS, MIN_UNIT_WORDS = 25, 4
WORD_CHARS, SHARD_BYTES = 6, 32 << 20
_CUT = re.compile(r"(?<=[.!?,;:])[ \t]+|[\r\n]+|(?<=[。！？｡])[ \t]*(?![。！？｡」』”’）\r\n])")
_FLUSH = 200_000


def units(text: str) -> list[tuple[int, int, int, int, int, int]]:
    """(start, end, words, digest, line, size) of each unit with a word; end is where the next unit may start.

    size is the words, or the characters by WORD_CHARS if that is more.
    """
    out, at, line = [], 0, 0
    for cut in [*((m.start(), m.end()) for m in _CUT.finditer(text)), (len(text), len(text))]:
        words = text[at : cut[0]].split()
        if words:
            out.append((at, cut[1], len(words), xxhash.xxh3_128_intdigest(" ".join(words).casefold().encode("utf-8", "surrogatepass")), line, max(len(words), sum(map(len, words)) // WORD_CHARS)))
        at = cut[1]
        line += text[cut[0] : at].strip(" \t") != ""
    return out


def runs(found: list[tuple], repeated: set[int], min_words: int = MIN_WORDS, min_unit_words: int = MIN_UNIT_WORDS, min_line_words: int = 0) -> list[tuple[int, int, int, int]]:
    """(start, end, words, size) of the spans to remove, ascending; repeated: numbers of the units found elsewhere before."""
    kept = {u[4] for k, u in enumerate(found) if k not in repeated}
    size: dict[int, int] = {}
    for u in found:
        size[u[4]] = size.get(u[4], 0) + u[5]
    gone, i = {k for k, u in enumerate(found) if u[4] not in kept and size[u[4]] >= min_line_words}, 0
    while i < len(found):
        if i not in repeated:
            i += 1
            continue
        j = i
        while j < len(found) and j in repeated:
            j += 1
        a, b = i, j
        if any(u[5] >= min_unit_words for u in found[i:j]):
            while found[a][5] < min_unit_words:
                a += 1
            while found[b - 1][5] < min_unit_words:
                b -= 1
        if sum(u[5] for u in found[a:b]) >= min_words:
            gone.update(range(a, b))
        i = j
    out: list[tuple[int, int, int, int]] = []
    for k in sorted(gone):
        start, end, words, size_ = *found[k][:3], found[k][5]
        if k - 1 in gone:
            before = out.pop()
            start, words, size_ = before[0], before[2] + words, before[3] + size_
        out.append((start, end, words, size_))
    return out


def _earliest(hi, lo, doc, no):
    """Order by digest, document and number, without repeats; and which of them are earliest."""
    order = np.lexsort((no, doc, lo, hi))
    hi, lo, doc, no = hi[order], lo[order], doc[order], no[order]
    same = np.zeros(len(hi), bool)
    same[1:] = (hi[1:] == hi[:-1]) & (lo[1:] == lo[:-1])
    again = same.copy()
    again[1:] &= (doc[1:] == doc[:-1]) & (no[1:] == no[:-1])
    return hi[~again], lo[~again], doc[~again], no[~again], ~same[~again]


def _homes(doc, no, shards: int):
    """Blobs of (document, unit number) for each home of documents."""
    home = mix(doc.view(U64)) % U64(shards)
    order = np.lexsort((no, doc, home))
    doc, no, home = doc[order], no[order], home[order]
    cut = np.searchsorted(home, np.arange(shards + 1, dtype=U64))
    for s in np.flatnonzero(np.diff(cut)):
        yield int(s), pack(doc[cut[s] : cut[s + 1]], no[cut[s] : cut[s + 1]])


def _digest_blocks(text_col: str, shards: int):
    """Rows (to_home, key, blob): a digest's earliest unit in the block goes to its range, settled repeats go home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hi: list[int] = []
        lo: list[int] = []
        doc: list[int] = []
        no: list[int] = []

        def flush() -> pa.RecordBatch:
            h, l, d, n, first = _earliest(np.array(hi, U64), np.array(lo, U64), np.array(doc, np.int64), np.array(no, np.int64))
            rows = [(True, k, b) for k, b in _homes(d[~first], n[~first], shards)]
            h, l, d, n = h[first], l[first], d[first], n[first]
            to = ((h >> U64(32)) * U64(shards)) >> U64(32)
            cut = np.searchsorted(to, np.arange(shards + 1, dtype=U64))
            for s in np.flatnonzero(np.diff(cut)):
                a, b = cut[s], cut[s + 1]
                ids, local = np.unique(d[a:b], return_inverse=True)
                rows.append((False, int(s), pack(h[a:b], l[a:b], ids, local, n[a:b])))
            for x in (hi, lo, doc, no):
                x.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["to_home", "key", "blob"]
            )

        for part in (p for batch in batches for p in slices(batch, text_col)):
            for id_, text in zip(part.column(0).to_pylist(), part.column(1)):
                for k, (_, _, _, digest, *_) in enumerate(units(text.as_py() or "")):
                    hi.append(digest >> 64)
                    lo.append(digest & 0xFFFFFFFFFFFFFFFF)
                    doc.append(id_)
                    no.append(k)
                if len(hi) >= _FLUSH:
                    yield flush()
        if hi:
            yield flush()

    return run


def _settle(shards: int):
    """A range of digests: every unit but the earliest of its digest is sent home; blobs for a home pass."""

    def run(group: pa.Table) -> pa.Table:
        keys, blobs, parts = [], [], []
        for to_home, key, blob in zip(*(group.column(c).to_pylist() for c in ("to_home", "key", "blob"))):
            if to_home:
                keys.append(key)
                blobs.append(blob)
            else:
                h, l, ids, local, n = unpack(blob)
                parts.append((h, l, ids.view(np.int64)[local.view(np.int64)], n.view(np.int64)))
        if parts:
            _, _, d, n, first = _earliest(*(np.concatenate(c) for c in zip(*parts)))
            for key, blob in _homes(d[~first], n[~first], shards):
                keys.append(key)
                blobs.append(blob)
        return pa.table({"home": pa.array(keys, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return run


def _per_document(group: pa.Table) -> pa.Table:
    parts = [unpack(b.as_py()) for b in group.column("blob")]
    doc = np.concatenate([p[0] for p in parts]).view(np.int64)
    no = np.concatenate([p[1] for p in parts]).view(np.int64)
    order = np.lexsort((no, doc))
    doc, no = doc[order], no[order]
    ids, at = np.unique(doc, return_index=True)
    cut = np.append(at, len(doc))
    return pa.table({"__id": pa.array(ids), "__repeated": pa.array([no[cut[i] : cut[i + 1]].astype(np.int32).tobytes() for i in range(len(ids))], pa.binary())})


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(__id, __repeated): of each document with any, the int32 numbers of its repeated units.

    Ranges of digests and homes of documents are as many as the shuffle partitions, or one for every
    shard_bytes of text if that is more.  The documents must come from a table or a checkpoint, as a
    task that is run again must find its rows in the same order.
    """
    shards = shards_for(docs, text_col, shard_bytes)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_col).where("id IS NOT NULL")
    blocks = rows.mapInArrow(tidy_batches(_digest_blocks(text_col, shards)), "to_home boolean, key int, blob binary")
    sent = blocks.groupBy("to_home", "key").applyInArrow(tidy(_settle(shards)), "home int, blob binary")
    return sent.groupBy("home").applyInArrow(tidy(_per_document), "__id long, __repeated binary")


def _removed(text: str | None, repeated: bytes | None, how: tuple[int, int, int]) -> list[tuple[int, int, int, int]]:
    if not text or not repeated:
        return []
    return runs(units(text), set(np.frombuffer(repeated, np.int32).tolist()), *how)


def _without(text: str | None, spans: list[tuple[int, int, int, int]]) -> str | None:
    out, at = [], 0
    for start, end, *_ in spans:
        out.append(text[at:start])
        at = end
    return "".join(out) + text[at:] if spans else text


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_unit_words: int = MIN_UNIT_WORDS, min_line_words: int = 0, spans: bool = True) -> DataFrame:
    """docs with the repeated passages taken out of the text.

    With spans, also removed (array of start, end in characters of the original text, words, and
    size: words, or characters by WORD_CHARS where that is more).
    """
    found = repeated_units(docs, id_col, text_col)
    if spans:
        docs = docs.drop("removed")
    key, mark = unused(docs.columns, "__id"), unused(docs.columns, "__repeated")
    both = docs.withColumn(key, F.col(id_col).cast("long")).join(found.toDF(key, mark), key, "left").drop(key)
    at, how = docs.columns.index(text_col), (min_words, min_unit_words, min_line_words)
    fields = ("start", "end", "words", "size")
    span = pa.struct([(x, pa.int32()) for x in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for batch in batches for p in slices(batch, text_col)):
            texts, gone = b.column(at).to_pylist(), []
            for i, repeated in enumerate(b.column(b.num_columns - 1)):
                gone.append(_removed(texts[i], repeated.as_py(), how))
                texts[i] = _without(texts[i], gone[-1])
            columns = [*b.columns[:-1]]
            columns[at] = pa.array(texts, pa.string())
            names = b.schema.names[:-1]
            if spans:
                columns.append(pa.array([[dict(zip(fields, x)) for x in g] for g in gone], pa.list_(span)))
                names = [*names, "removed"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    plain = both.drop(mark)
    schema = plain.withColumn("removed", F.lit(None).cast("array<struct<start:int,end:int,words:int,size:int>>")).schema if spans else plain.schema
    return both.mapInArrow(tidy_batches(run), schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts without what is repeated.

    ``removed`` are the spans of MIN_WORDS words or more and n_passages their number, ``removed_lines``
    those of shorter lines, as start-end pairs of characters of the original text; null where there are none.
    """
    out = dedup(table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text"))
    words = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["words"])
    long, short = F.filter("removed", lambda x: x["size"] >= MIN_WORDS), F.filter("removed", lambda x: x["size"] < MIN_WORDS)
    said = lambda some: F.nullif(F.array_join(F.transform(some, lambda x: F.concat_ws("-", x["start"], x["end"])), ","), F.lit(""))
    return out.select(
        "doc_id", "text", said(long).alias("removed"), said(short).alias("removed_lines"), F.size(long).cast("long").alias("n_passages"),
        F.size("removed").cast("long").alias("n_removed"), words.alias("removed_words"),
    )


QUERIES = {"op2_substring_dedup": op2_substring_dedup}


def oracle(min_line_words: int = 0) -> str:
    """DuckDB SQL of op2's rows; without the ideographic sentence ends, which need a look ahead."""
    return rf"""
WITH m AS (
  SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '([.!?,;:])([ \t]+)', '\1' || chr(1) || '\2' || chr(2), 'g'), '([\r\n]+)', chr(1) || '\1' || chr(2), 'g'), chr(2))) AS x,
         generate_subscripts(string_split(regexp_replace(regexp_replace(text, '([.!?,;:])([ \t]+)', '\1' || chr(1) || '\2' || chr(2), 'g'), '([\r\n]+)', chr(1) || '\1' || chr(2), 'g'), chr(2)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id, i, split_part(x, chr(1), 1) AS u, split_part(x, chr(1), 2) AS sep FROM m),
p AS (
  SELECT doc_id, i, u, u || sep AS whole, CAST(sum(length(u) + length(sep)) OVER w - length(u) - length(sep) AS BIGINT) AS a, CAST(sum(length(u) + length(sep)) OVER w AS BIGINT) AS z,
         count(*) FILTER (regexp_matches(sep, '[\r\n]')) OVER w - CAST(regexp_matches(sep, '[\r\n]') AS INT) AS line, regexp_extract_all(u, '\S+') AS ws
  FROM q WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
un AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, len(ws) AS n, greatest(len(ws), list_sum(list_transform(ws, lambda y: length(y))) // {WORD_CHARS}) AS size,
         replace(lower(array_to_string(ws, ' ')), 'ß', 'ss') AS norm
  FROM p WHERE len(ws) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, k) > 1 AS rep FROM un),
isl AS (SELECT *, bool_and(rep) OVER (PARTITION BY doc_id, line) AND sum(size) OVER (PARTITION BY doc_id, line) >= {min_line_words} AS all_line, k - row_number() OVER (PARTITION BY doc_id, rep ORDER BY k) AS g FROM r),
ends AS (
  SELECT doc_id, g, coalesce(min(k) FILTER (size >= {MIN_UNIT_WORDS}), min(k)) AS x, coalesce(max(k) FILTER (size >= {MIN_UNIT_WORDS}), max(k)) AS y FROM isl WHERE rep GROUP BY ALL),
tot AS (SELECT e.doc_id, e.x, e.y FROM ends e JOIN r ON r.doc_id = e.doc_id AND r.k BETWEEN e.x AND e.y GROUP BY ALL HAVING sum(size) >= {MIN_WORDS}),
gone AS (SELECT * FROM isl WHERE all_line OR EXISTS (SELECT 1 FROM tot WHERE tot.doc_id = isl.doc_id AND isl.k BETWEEN tot.x AND tot.y)),
sp AS (
  SELECT doc_id, min(a) AS a, max(z) AS z, sum(n) AS n, sum(size) AS size
  FROM (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS h FROM gone) GROUP BY doc_id, h),
kept AS (
  SELECT doc_id, string_agg(whole, '' ORDER BY i) AS text FROM p
  WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.doc_id = p.doc_id AND p.a >= sp.a AND p.a < sp.z) GROUP BY doc_id),
li AS (
  SELECT doc_id, count(*) AS n_removed, CAST(sum(n) AS BIGINT) AS removed_words,
         string_agg(a || '-' || z, ',' ORDER BY a) FILTER (size >= {MIN_WORDS}) AS removed, count(*) FILTER (size >= {MIN_WORDS}) AS n_passages,
         string_agg(a || '-' || z, ',' ORDER BY a) FILTER (size < {MIN_WORDS}) AS removed_lines
  FROM sp GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text, removed, removed_lines, coalesce(n_passages, 0) AS n_passages,
       coalesce(n_removed, 0) AS n_removed, coalesce(removed_words, 0) AS removed_words
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN li USING (doc_id)"""


ORACLE_SQL = {"op2_substring_dedup": oracle()}
