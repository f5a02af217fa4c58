r"""Exact n-gram Jaccard self-join with set-relation skipping.

A document's set is its distinct word 5-grams; two documents link when their sets' Jaccard
similarity is at least 0.8.  The join is exact and proceeds in these steps:

1. *Frequencies.*  Shingle hashes are dealt out by range, packed by block of documents.  Each
   range counts in how many documents a shingle occurs and answers, for each document, how
   many distinct shingles it has there and which of them occur elsewhere too.  A shingle that
   ``hot`` documents of one block share is sent as one count; the block's documents wait with the
   block, which asks for the sum and then tells them.  So a shingle of a third of all documents
   is one entry a block at its range.  Shingles of one document only can match nothing; a
   document with under 80 % others can link with nothing and leaves the join.
2. *Copies.*  Equal sets are one class with its smallest id as representative.
3. *Index by position.*  Shingles are ordered by frequency, rarest first; two sets that link
   share a shingle in the first n - ceil(0.8 n) + 1 of each.  The index has one list for each
   such shingle, whose entries hold the set's size and the shingle's position.
4. *Answers of pivots.*  The most central set of each list (the one with the least share of
   shingles of its own) is verified against the list's other sets, each pivot's in portions of
   ``portion``.  That is linear in the index, however long a list is, and joins each group of near
   copies into one class.
5. *Derived answers.*  Two members of one class need no further test: only the class is asked
   for, and a list's largest class is compared with the rest of the list only.  Entries are sorted by
   size and position and cut into blocks that keep their least size and most words left; blocks
   whose sizes or positions rule a link out are skipped whole.  A pair with a common pivot is
   rejected, or accepted, from the two overlaps with the pivot wherever their bounds suffice.  What
   remains is verified on the sets.  Lists longer than ``list_block`` are dealt out as pairs of blocks.

Classes are the connected components of all links.  Ranges and homes of documents are as many as the
shuffle partitions, or one for every ``shard_bytes`` of text if that is more.

Hashes have 56 bits; unequal shingles of a pair of documents with 500 shingles each share one
with probability 4e-12.

Defined results: a null or empty text has the empty set, links with nothing and is its own
class; a text with fewer words than a shingle is one shingle; rows that share an id are one
document with the union of their sets; rows with a null id get null n_shingles and class; very long
texts are whole sets; an empty table gives an empty result; other columns are not read.  The tables
that the result reads stay in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .packing import pack, release, tidy, tidy_batches, unpack
from .tables import discard, shards_for, table, written
from .wordhash import U64, mix, ngram_hashes, slices, text_bytes, word_hashes, word_spans

BITS = 56
WORDS, PERCENT = 5, 80
HOT, PORTION, SHARD_BYTES, SKIP = 256, 4096, 32 << 20, 64
_FLUSH = 1_000_000


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> U64(BITS - 32)) * U64(shards)) >> U64(32)


def _need(percent: int, n):
    """Least overlap of a set of size n with anything that links with it."""
    return -(-percent * n // 100)


def shingles(raw: bytes, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every shingle, repeats included; texts ascending."""
    starts, ends, counts = word_spans(raw, offsets)
    h = word_hashes(raw, starts, ends)
    text = np.repeat(np.arange(len(counts)), counts)
    g = ngram_hashes(h, words)
    at = np.flatnonzero(text[: len(g)] == text[words - 1 :]) if len(g) else np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    hashes, texts = [g[at]], [text[at]]
    for n in range(1, words):
        short = np.flatnonzero(counts == n)
        if len(short):
            total = np.zeros(len(short), U64)
            for k in range(n):
                total = mix(total + h[first[short] + k])
            hashes.append(mix(total + U64(n)))
            texts.append(short)
    return np.concatenate(hashes) >> U64(64 - BITS), np.concatenate(texts)


def _first_of(*columns: np.ndarray) -> np.ndarray:
    """Which rows of sorted columns differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _emit_blocks(text_col: str, words: int, shards: int, hot: int):
    """Rows (block, shard, blob): entries for a range of hashes, or with block the hot entries that wait."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_h, held_d, size, n = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            block = f"{TaskContext.get().partitionId()}-{n}"
            h, d = np.concatenate(held_h), np.concatenate(held_d)
            ids, d = np.unique(d, return_inverse=True)
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = _first_of(h, d)
            h, d = h[new], d[new]
            at = np.flatnonzero(_first_of(h))
            k = np.diff(np.append(at, len(h)))
            many = np.repeat(k >= hot, k)
            blocks, keys, blobs = [], [], []
            if many.any():
                blocks, keys, blobs = [block], [-1], [pack(ids, h[many], d[many])]
            own_h, own_k = h[at][k >= hot], k[k >= hot]
            h, d = h[~many], d[~many]
            to, own_to = _shard(h, shards), _shard(own_h, shards)
            cut, own_cut = (np.searchsorted(x, np.arange(shards + 1, dtype=U64)) for x in (to, own_to))
            for s in np.flatnonzero(np.diff(cut) + np.diff(own_cut)):
                a, b = cut[s], cut[s + 1]
                own, local = np.unique(d[a:b], return_inverse=True)
                hot_part = slice(own_cut[s], own_cut[s + 1])
                blocks.append(block)
                keys.append(int(s))
                blobs.append(pack(ids[own], h[a:b], local, own_h[hot_part], own_k[hot_part]))
            held_h.clear()
            held_d.clear()
            return pa.RecordBatch.from_arrays([pa.array(blocks, pa.string()), pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], names=["block", "shard", "blob"])

        for batch in batches:
            for part in slices(batch, text_col):
                h, t = shingles(*text_bytes(part.column(1), lower=True), words)
                held_h.append(h)
                held_d.append(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[t])
                size += len(h)
                if size >= _FLUSH:
                    yield flush()
                    size, n = 0, n + 1
        if size:
            yield flush()

    return run


def _rank(df: np.ndarray) -> np.ndarray:
    return np.minimum(8 * np.log2(df), 255).astype(np.int64)


def _homes(h: np.ndarray, d: np.ndarray, df: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """Each home's documents with their number of these shingles, and those that others have too."""
    home = mix(d.view(U64)) % U64(shards)
    order = np.lexsort((h, d, home))
    h, d, df, home = h[order], d[order], df[order], home[order]
    cut = np.searchsorted(home, np.arange(shards + 1, dtype=U64))
    for s in np.flatnonzero(np.diff(cut)):
        a, b = cut[s], cut[s + 1]
        ids, count = np.unique(d[a:b], return_counts=True)
        shared = df[a:b] > 1
        per = np.bincount(np.searchsorted(ids, d[a:b][shared]), minlength=len(ids))
        yield int(s), pack(ids, count, per, h[a:b][shared], _rank(df[a:b][shared]))


_ANSWER = "block string, home int, blob binary"


def _answer(blocks: list, homes: list, blobs: list) -> pa.Table:
    return pa.table({"block": pa.array(blocks, pa.string()), "home": pa.array(homes, pa.int32()), "blob": pa.array(blobs, pa.binary())})


def _count_shard(shards: int):
    """A range: answers for homes, and sums of hot shingles for the blocks that wait; what waits passes."""

    def run(group: pa.Table) -> pa.Table:
        if len(group) and group.column("shard")[0].as_py() < 0:
            return _answer(group.column("block").to_pylist(), [-1] * len(group), group.column("blob").to_pylist())
        hs, ds, hot = [], [], []
        for block, blob in zip(group.column("block").to_pylist(), group.column("blob")):
            ids, h, local, own_h, own_k = unpack(blob.as_py())
            hs.append(h)
            ds.append(ids.view(np.int64)[local.view(np.int64)])
            if len(own_h):
                hot.append((block, own_h, own_k.view(np.int64)))
        h, d = np.concatenate(hs), np.concatenate(ds)
        del hs, ds
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        new = _first_of(h, d)
        h, d = h[new], d[new]
        at = np.flatnonzero(_first_of(h))
        k = np.diff(np.append(at, len(h)))
        df = np.repeat(k, k)
        blocks, homes, blobs = [], [], []
        if hot:
            # An id with rows in several blocks counts for each of them; the order by frequency may be any.
            known, inverse = np.unique(np.concatenate([x[1] for x in hot]), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([x[2] for x in hot]), len(known)).astype(np.int64)
            if len(at):
                place = np.minimum(np.searchsorted(h[at], known), len(at) - 1)
                total += np.where(h[at][place] == known, k[place], 0)
                to = np.searchsorted(known, h)
                to[to == len(known)] = 0
                df = np.where(known[to] == h, total[to], df)
            for block, own_h, _ in hot:
                blocks.append(block)
                homes.append(-2)
                blobs.append(pack(own_h, total[np.searchsorted(known, own_h)]))
        for s, blob in _homes(h, d, df, shards):
            blocks.append(None)
            homes.append(s)
            blobs.append(blob)
        return _answer(blocks, homes, blobs)

    return run


def _tell(shards: int):
    """A block's hot entries and the sums it asked for, to answers for homes."""

    def run(group: pa.Table) -> pa.Table:
        homes = group.column("home").to_pylist()
        sums = [unpack(b.as_py()) for b, home in zip(group.column("blob"), homes) if home == -2]
        known, total = (np.concatenate([x[i] for x in sums]) for i in (0, 1))
        order = np.argsort(known)
        known, total = known[order], total[order].view(np.int64)
        ids, h, local = unpack(next(b for b, home in zip(group.column("blob"), homes) if home == -1).as_py())
        d = ids.view(np.int64)[local.view(np.int64)]
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        if (known[at] != h).any():
            raise RuntimeError("a block changed when it was read again: the documents must come from a table or a checkpoint")
        found = list(_homes(h, d, total[at], shards))
        return _answer([None] * len(found), [s for s, _ in found], [b for _, b in found])

    return run


def _assemble(percent: int):
    """One row for each document: n, and for those that may link their shared shingles and index prefix."""

    def run(group: pa.Table) -> pa.Table:
        parts = [unpack(b.as_py()) for b in group.column("blob")]
        ids, inverse = np.unique(np.concatenate([p[0] for p in parts]).view(np.int64), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([p[1] for p in parts]).view(np.int64), len(ids)).astype(np.int64)
        per = np.concatenate([p[2] for p in parts]).view(np.int64)
        doc = np.repeat(inverse, per)
        h, rank = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts]).view(np.int64)
        del parts
        # An id with rows in several blocks may get a hot shingle, which others always have too, from each of them.
        order = np.lexsort((h, rank, doc))
        doc, h = doc[order], h[order]
        new = _first_of(doc, h)
        n -= np.bincount(doc[~new], minlength=len(ids))
        doc, h = doc[new], h[new]
        m = np.bincount(doc, minlength=len(ids))
        need = _need(percent, n)
        may = (m >= need) & (m > 0)
        keep = may[doc]
        doc, h = doc[keep], h[keep]
        cut = np.searchsorted(doc, np.arange(len(ids) + 1))
        sets, prefixes, digests = [], [], []
        for i in range(len(ids)):
            if not may[i]:
                sets.append(None), prefixes.append(None), digests.append(None)
                continue
            own = h[cut[i] : cut[i + 1]]
            prefixes.append(own[: n[i] - need[i] + 1 - (n[i] - m[i])].view(np.int64))
            own = np.sort(own)
            sets.append(own.tobytes())
            digests.append(xxhash.xxh3_128_digest(sets[-1]) if m[i] == n[i] else None)
        return pa.table(
            {
                "doc_id": pa.array(ids),
                "n": pa.array(n),
                "own": pa.array(n - m),
                "shared": pa.array(sets, pa.binary()),
                "prefix": pa.array(prefixes, pa.list_(pa.int64())),
                "digest": pa.array(digests, pa.binary()),
            }
        )

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, shared_a, shared_b) to (a, b, na, nb, overlap)."""
    for batch in batches:
        out = np.zeros(batch.num_rows, np.int64)
        for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
            x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            out[i] = (y[at] == x).sum() if len(y) else 0
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out)], names=["a", "b", "na", "nb", "overlap"])


def _verified(pairs: DataFrame, sets: DataFrame, portion: int = PORTION) -> DataFrame:
    """pairs (a, b) with both sizes and the overlap of their sets; an a with many b meets them in portions."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / portion).cast("int").alias("parts"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("shared_b"))
    a = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("shared").alias("shared_a"))
    a = a.join(many, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = pairs.select("a", "b").join(many.where("parts > 1"), "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int"))
    both = dealt.drop("parts").join(b, "b").join(a, ["a", "part"]).select("a", "b", "na", "nb", "shared_a", "shared_b")
    return both.mapInArrow(tidy_batches(_overlaps), "a long, b long, na long, nb long, overlap long")


_NO_PAIRS = pa.table({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "sure": np.zeros(0, bool)})


def _links(percent: int):
    return F.col("overlap") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))


class SkipList:
    """Index entries sorted by size and position, in blocks that are skipped whole by either."""

    def __init__(self, n: np.ndarray, pos: np.ndarray, percent: int, block: int = SKIP):
        self.n, self.left, self.percent, self.block = n, n - pos - 1, percent, block
        start = np.arange(0, len(n), block)
        self.least, self.most_left = n[start], np.maximum.reduceat(self.left, start) if len(n) else self.left
        self.end = np.searchsorted(n, 100 * n // percent, "right")
        self.visited = 0

    def pairs(self, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs i < j that size and position allow to link, in portions of about ``most``."""
        if len(self.n) <= self.block:
            i, j = np.nonzero(np.arange(len(self.n))[:, None] < np.arange(len(self.n)))
            fits = (j < self.end[i]) & (1 + np.minimum(self.left[i], self.left[j]) >= self.need(self.n[i], self.n[j]))
            yield i[fits], j[fits]
            return
        found, first, size = [], 0, 0
        for i in range(len(self.n)):
            found.append(self.after(i))
            size += len(found[-1])
            if size >= most or i + 1 == len(self.n):
                yield np.repeat(np.arange(first, i + 1), [len(j) for j in found]), np.concatenate(found)
                found, first, size = [], i + 1, 0

    def need(self, n, other: np.ndarray) -> np.ndarray:
        """Least overlap of two sets of these sizes that link."""
        return -(-self.percent * (n + other) // (100 + self.percent))

    def after(self, i: int) -> np.ndarray:
        """Later entries that size and position allow to link with entry i."""
        if i + 1 >= self.end[i]:
            return np.zeros(0, np.int64)
        blocks = np.arange((i + 1) // self.block, (self.end[i] - 1) // self.block + 1)
        n, left = int(self.n[i]), self.left[i]
        blocks = blocks[1 + np.minimum(left, self.most_left[blocks]) >= self.need(n, self.least[blocks])]
        self.visited += len(blocks)
        j = (blocks[:, None] * self.block + np.arange(self.block)).ravel()
        j = j[(j > i) & (j < self.end[i])]
        return j[1 + np.minimum(left, self.left[j]) >= self.need(n, self.n[j])]


def _pairs_within(tok: np.ndarray, entries: SkipList) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for many lists of at most SKIP entries at once, sorted by list, size and position."""
    n, left = entries.n, entries.left
    for k in range(1, SKIP):
        i = np.flatnonzero(tok[k:] == tok[:-k])
        if not len(i):
            return
        j = i + k
        yield tuple(x[(100 * n[i] >= entries.percent * n[j]) & (1 + np.minimum(left[i], left[j]) >= entries.need(n[i], n[j]))] for x in (i, j))


def _derive(percent: int):
    """Pairs of one list, or of two parts of it, or of many short lists, between different classes: sure links, and candidates.

    Entries come with size n, position, class, side, and their overlap with their pivot.  Where only
    the two parts are to be compared (``across``), sides tell them apart.
    """

    def run(group: pa.Table) -> pa.Table:
        col = {c: group.column(c).to_numpy() for c in ("tok", "doc_id", "n", "pos", "comp", "pivot", "pivot_n", "over", "side")}
        order = np.lexsort((col["pos"], col["n"], col["tok"]))
        col = {c: v[order] for c, v in col.items()}
        n, comp, side, over, pivot = (col[c] for c in ("n", "comp", "side", "over", "pivot"))
        across = bool(group.column("across")[0].as_py())
        entries = SkipList(n, col["pos"], percent)
        out = []
        many = bool((col["tok"][1:] != col["tok"][:-1]).any())
        for i, j in _pairs_within(col["tok"], entries) if many else entries.pairs():
            keep = comp[i] != comp[j]
            if across:
                keep &= side[i] != side[j]
            i, j = i[keep], j[keep]
            # Overlaps o and p with a common pivot of size m: their own is at least o + p - m and at most min(o, p) + min of the rests.
            need, o, p = entries.need(n[i], n[j]), over[i], over[j]
            common = (pivot[i] == pivot[j]) & (pivot[i] >= 0)
            open_ = ~common | (np.minimum(o, p) + np.minimum(n[i] - o, n[j] - p) >= need)
            sure = common & (o + p - col["pivot_n"][i] >= need)
            x, y = col["doc_id"][i[open_]], col["doc_id"][j[open_]]
            out.append(pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y), "sure": sure[open_]}))
        if len(n) > 1000:
            release()
        return pa.concat_tables(out) if out else _NO_PAIRS

    return run


def _dealt(label: DataFrame, best: DataFrame, list_block: int, shards: int) -> DataFrame:
    """Entries of the lists with several classes, dealt out to groups (key, kind, lo, hi).

    Lists of up to SKIP entries share groups, a list of up to list_block is one group.  Of a longer one the largest class is only
    compared with the rest of the list, part by part (across); the rest is compared with itself, too, as
    pairs of parts.
    """
    sizes = label.groupBy("tok", "comp").agg(F.count("*").alias("size"))
    top = sizes.groupBy("tok").agg(F.max(F.struct("size", "comp")).alias("top"), F.sum("size").alias("total")).where("total > top.size")
    parts = lambda c: F.greatest(F.ceil(c / list_block), F.lit(1)).cast("int")
    key = F.when(F.col("total") <= min(SKIP, list_block), F.pmod(F.xxhash64("tok"), F.lit(4 * shards))).otherwise(F.col("tok"))
    top = top.select("tok", key.alias("key"), (F.col("total") <= min(SKIP, list_block)).alias("tiny"), F.when(F.col("total") > list_block, F.col("top.comp")).alias("major"), parts(F.col("top.size")).alias("n_major"), parts(F.col("total") - F.col("top.size")).alias("n_minor"))
    rest = label.join(top, "tok").join(best.select(F.col("b").alias("doc_id"), "best"), "doc_id", "left")
    rest = rest.withColumns({"pivot": F.coalesce("best.a", F.lit(-1)), "pivot_n": F.coalesce("best.na", F.lit(0)), "over": F.coalesce("best.overlap", F.lit(0))})
    rest = rest.withColumns({"is_major": F.coalesce(F.col("comp") == F.col("major"), F.lit(False)), "short": F.col("major").isNull()})
    rest = rest.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.when(F.col("is_major"), F.col("n_major")).otherwise(F.col("n_minor"))).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    deal = lambda across, lo, hi, side: F.struct(F.lit(across).alias("across"), lo.alias("lo"), hi.alias("hi"), side.alias("side"))
    own, zero, one = F.col("own"), F.lit(0), F.lit(1)
    major = F.transform(upto("n_minor"), lambda k: deal(True, k, own, one))
    minor = F.concat(F.transform(upto("n_major"), lambda k: deal(True, own, k, zero)), F.transform(upto("n_minor"), lambda k: deal(False, F.least(own, k), F.greatest(own, k), own)))
    rest = rest.withColumn("to", F.explode(F.when(F.col("short"), F.array(deal(False, zero, zero, zero))).when(F.col("is_major"), major).otherwise(minor)))
    # Pairs within a part are compared where the part meets itself.
    return rest.select("key", "tiny", "tok", "doc_id", "n", "pos", "comp", "pivot", "pivot_n", "over", (F.col("to.across") | (F.col("to.lo") < F.col("to.hi"))).alias("across"), F.col("to.across").alias("kind"), "to.lo", "to.hi", "to.side")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, list_block: int = 2048, hot: int = HOT, portion: int = PORTION, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each id: doc_id, n_shingles, component_id (the smallest id reachable over links)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shards = shards_for(rows, "text", shard_bytes)

    blocks = rows.where("doc_id IS NOT NULL").mapInArrow(tidy_batches(_emit_blocks("text", words, shards, hot)), "block string, shard int, blob binary")
    # What waits with its block goes by the block, everything else by the range of hashes.
    blocks = blocks.withColumn("waits", F.when(F.col("shard") < 0, F.col("block")))
    counted = written(blocks.groupBy("shard", "waits").applyInArrow(tidy(_count_shard(shards)), _ANSWER), "counted")
    told = counted.where("home < 0").groupBy("block").applyInArrow(tidy(_tell(shards)), _ANSWER)
    answers = counted.where("home >= 0").unionByName(told)
    sets = answers.groupBy("home").applyInArrow(tidy(_assemble(percent)), "doc_id long, n long, own long, shared binary, prefix array<long>, digest binary")
    sets = written(sets, "sets")
    discard(counted)

    copies = sets.where("digest IS NOT NULL").groupBy("n", "digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")).where("k > 1")
    member = written(sets.where("digest IS NOT NULL").join(copies, ["n", "digest"]).where("doc_id != rep").select("doc_id", "rep"), "copies")
    reps = sets.where("shared IS NOT NULL").join(member.select("doc_id"), "doc_id", "left_anti")

    index = reps.select("doc_id", "n", "own", F.posexplode("prefix").alias("at", "tok"))
    index = index.select("tok", "doc_id", "n", "own", (F.col("own") + F.col("at")).alias("pos"))
    central = F.struct((F.col("own") * 1_000_000 / F.col("n")).cast("long").alias("own_share"), "doc_id", "n", "pos")
    lists = index.groupBy("tok").agg(F.min(central).alias("pivot"), F.count("*").alias("k")).where("k > 1").select("tok", "pivot", "k")
    index = written(index.join(lists, "tok"), "index")

    fits = (F.least("n", "pivot.n") * 100 >= F.greatest("n", "pivot.n") * percent) & (
        1 + F.least(F.col("n") - F.col("pos") - 1, F.col("pivot.n") - F.col("pivot.pos") - 1) >= F.ceil((F.col("n") + F.col("pivot.n")) * percent / (100 + percent))
    )
    tried = written(index.where((F.col("doc_id") != F.col("pivot.doc_id")) & fits).select(F.col("pivot.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct(), "tried")
    answers = written(_verified(tried, reps, portion), "answers")
    first = components(answers.where(_links(percent)).select("a", "b"))

    best = answers.groupBy("b").agg(F.max_by(F.struct("a", "na", "overlap"), F.struct("overlap", "a")).alias("best"))
    label = written(index.join(first, index.doc_id == first.node, "left").select("tok", "doc_id", "n", "pos", F.coalesce("component", "doc_id").alias("comp")), "label")
    found = _dealt(label, best, list_block, shards).groupBy("key", "tiny", "kind", "lo", "hi").applyInArrow(_derive(percent), "a long, b long, sure boolean")
    found = written(found.groupBy("a", "b").agg(F.max("sure").alias("sure")), "derived")
    done = answers.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    open_ = found.where("NOT sure").select("a", "b").join(done, ["a", "b"], "left_anti")
    more = _verified(open_, reps, portion).where(_links(percent)).select("a", "b").union(found.where("sure").select("a", "b"))

    # The classes so far stand for themselves as edges to their smallest member.
    every = first.toDF("a", "b").union(more).union(member.toDF("a", "b"))
    final = components(every)
    discard(index, tried, answers, member, first, label, found)
    size = sets.select("doc_id", "n")
    out = rows.select("doc_id").join(size, "doc_id", "left").join(final, F.col("doc_id") == F.col("node"), "left")
    known = F.col("doc_id").isNotNull()
    return out.select(
        F.col("doc_id").alias(id_col),
        F.when(known, F.coalesce("n", F.lit(0))).cast("long").alias("n_shingles"),
        F.coalesce("component", "doc_id").cast("long").alias("component_id"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows whose id is the smallest of its class, all columns unchanged; rows with a null id stay."""
    classes = join(docs, id_col, text_col, **how)
    gone = classes.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents", "doc_id"))


QUERIES = {"op8_jaccard_join": op8_jaccard_join}

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL = {
    "op8_jaccard_join": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_A}', '{_Z}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.doc_id)
SELECT d.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id"""
}
