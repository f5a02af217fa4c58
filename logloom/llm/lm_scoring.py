r"""Trigram language-model scores from Elias-Fano tries that grow with the corpus.

Counts are exact over all training texts; the model is sharded by the first word of an n-gram
and never gathered in one place.

1. *Layout.*  Blocks of documents become token numbers over the block's own sorted word hashes,
   one row a block, written once to the shared folder.
2. *Requests.*  For each shard (a range of word hashes) a block sends its distinct words,
   bigrams and trigrams whose first word lies there, as a small trie with training counts.
   Words that a sample finds frequent (at most 65,536) go by number instead of by hash.
3. *Tries.*  A shard adds up the blocks' tries and builds its part of the model: levels with
   Elias-Fano pointers, bit-packed children and quantised probabilities, memory-mapped from files
   that live as long as the task.  It then finds every requested n-gram by successor search inside
   its context's run, and answers each block in the block's own order, so answers are codes without
   keys.
4. *Scores.*  A block's layout meets its answers and gives one row for each document.

Probabilities are Dirichlet-smoothed: p(w|h) = (c(hw) + mu p(w|h')) / (c(h) + mu), c(h) being
how often h has a successor, down to p(w) = (c(w) + 1) / (N + V + 1).  Over the vocabulary and
one unknown word they add up to 1 before quantisation.  Words before the text's start do not
exist: its first token has no context and its second has one word.

Hot words: a word with more than a shard's share of the sampled tokens is spread over as many shards
as its share calls for, its bigrams (with their trigrams) dealt out by the second word.  Every block
tells all of them the word's own count, which is the count of the context as every word but the end
has a successor.  A shard takes blocks * (n-grams a block has there) entries, and counts are added
without being expanded.  There are at least two shards for each shuffle partition and one for every
``shard_bytes`` of layout, so a session with few partitions does not get large shards.  A block sends a
row to the shards it has words for: at most as many rows as it has words, so rows grow with blocks
times shards only until shards outnumber a block's words; larger executors can take larger blocks.

Defined results: a null or empty text is its end token alone; repeated rows are scored, and
counted in training, one by one; a null id counts as the empty string for the fold; very long texts
are whole and one block each; an empty table gives an empty result; other columns, whatever their
names, are not read; without training texts every token is unknown.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .elias_fano import Level, Mapped, quantise, restore
from .packing import pack, ranked, release, tidy, tidy_batches, unpack
from .tables import fold, n_partitions, table, written
from .wordhash import PIECE, U64, mix, slices, text_bytes, word_hashes, word_spans

END = 0xE0D0F7EC7A11D0CE
MU = 4.0
BLOCK_BYTES, SHARD_BYTES = 4 << 20, 8 << 20


def _tokens(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts, each followed by END, and the number of tokens of each text."""
    starts, ends, counts = word_spans(raw, offsets)
    out = np.full(len(starts) + len(counts), U64(END), U64)
    text = np.repeat(np.arange(len(counts)), counts)
    out[np.arange(len(starts)) + text] = word_hashes(raw, starts, ends)
    return out, counts + 1


def _layout(block_bytes: int):
    """(doc_id, text, train) to one row (block, blob) for about block_bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks(batches, block_bytes)

    return run


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = n = 0

    def flush() -> pa.RecordBatch:
        words, token, count = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True, return_counts=True)
        # Stored by falling frequency, so that most numbers are short.
        rank = np.argsort(-count, kind="stable")
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        token = place[token]
        lengths, ids, null, train = (np.concatenate([h[k] for h in held]) for k in range(1, 5))
        return pa.RecordBatch.from_pydict({"block": [f"{TaskContext.get().partitionId()}-{n}"], "blob": [pack(words, rank, token, lengths, ids, null, train)]})

    for batch in batches:
        for part in slices(batch, "text", PIECE):
            raw, offsets = text_bytes(part.column(1), lower=True)
            ids = part.column(0)
            held.append((*_tokens(raw, offsets), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), part.column(2).to_numpy(zero_copy_only=False).astype(np.int64)))
            size += len(raw)
            if size >= block_bytes:
                yield flush()
                held.clear()
                size, n = 0, n + 1
    if held:
        yield flush()


def _distinct(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with the inverse, for keys of so many bits; sorts key and place as one number where they fit."""
    n = len(key)
    low = max(1, n.bit_length())
    if bits + low <= 63:
        both = np.sort(key << low | np.arange(n))
        order, key = both & ((1 << low) - 1), both >> low
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    inverse = np.empty(n, np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    return key[new], inverse


class _Block:
    """A block's words and its distinct bigrams and trigrams, in order of their words' hashes."""

    def __init__(self, blob: bytes):
        self.words, self.rank, token, lengths, ids, null, train = unpack(blob)
        token = self.token = self.rank.astype(np.int32)[token.view(np.int64)]
        self.lengths, self.ids, self.null, self.train = (x.view(np.int64) for x in (lengths, ids, null, train))
        bits = max(1, len(self.words).bit_length())
        end = np.cumsum(self.lengths)
        self.first = end - self.lengths
        counted = np.repeat(self.train.astype(bool), self.lengths)
        self.c1 = np.bincount(token[counted], minlength=len(self.words))
        inner = np.ones(len(token), bool)
        inner[end - 1] = False  # a text's last token has no successor
        self.at2 = np.flatnonzero(inner).astype(np.int32)
        inner[(end - 2)[self.lengths > 1]] = False
        self.at3 = np.flatnonzero(inner).astype(np.int32)
        del inner
        key, self.of2 = _distinct(token[self.at2].astype(np.int64) << bits | token[self.at2 + 1], 2 * bits)
        self.c2 = np.bincount(self.of2[counted[self.at2]], minlength=len(key))
        self.w2a, self.w2b = (key >> bits).astype(np.int32), (key & ((1 << bits) - 1)).astype(np.int32)
        node = np.zeros(len(token), np.int32)
        node[self.at2] = self.of2
        key, self.of3 = _distinct(node[self.at3].astype(np.int64) << bits | token[self.at3 + 2], len(key).bit_length() + bits)
        self.c3 = np.bincount(self.of3[counted[self.at3]], minlength=len(key))
        self.n3, self.w3c = (key >> bits).astype(np.int32), (key & ((1 << bits) - 1)).astype(np.int32)


class Hot:
    """Words that are spread over several shards: hashes, ascending, and over how many shards each."""

    def __init__(self, words: np.ndarray, share: np.ndarray, shards: int):
        n = np.minimum(np.ceil(share * shards), shards).astype(np.int64)
        order = np.flatnonzero(n > 1)
        order = order[np.argsort(words[order])]
        self.words, self.n = words[order], n[order]

    def spread(self, words: np.ndarray) -> np.ndarray:
        """For each word over how many shards it goes."""
        out = np.ones(len(words), np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            out = np.where(self.words[at] == words, self.n[at], out)
        return out


class _Route:
    """Which shard a block's words, bigrams and trigrams go to."""

    def __init__(self, b: _Block, shards: int, hot: Hot):
        base = (((b.words >> U64(32)) * U64(shards)) >> U64(32)).astype(np.int64)
        n = hot.spread(b.words)
        two = base[b.w2a]
        split = np.flatnonzero(n[b.w2a] > 1)
        if len(split):
            own = n[b.w2a[split]]
            two[split] = (two[split] + (mix(b.words[b.w2b[split]]) % own.astype(U64)).astype(np.int64)) % shards
        three = two[b.n3]
        every = np.arange(shards + 1)
        small = np.uint16 if shards < 1 << 16 else np.int64  # short keys are sorted by radix
        self.order2, self.order3 = (np.argsort(x.astype(small), kind="stable") for x in (two, three))
        self.one = np.searchsorted(base, every)
        self.two, self.three = np.searchsorted(two[self.order2], every), np.searchsorted(three[self.order3], every)
        # Hot words at their other shards, by shard and word.
        word = np.repeat(np.arange(len(n)), n - 1)
        turn = np.arange(len(word)) - np.repeat(np.cumsum(n - 1) - (n - 1), n - 1) + 1
        shard = (base[word] + turn) % shards
        by = np.lexsort((word, shard))
        self.guest, self.guests = word[by], np.searchsorted(shard[by], every)


def _sampled(layout: DataFrame, blocks: int = 16, most: int = 1 << 16) -> tuple[int, np.ndarray, np.ndarray]:
    """Bytes of the layout, and the most frequent words of about so many blocks with their share of the tokens there.

    They give words short names and hot words more shards; neither has an effect on results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                words, rank, token, *_ = unpack(blob.as_py())
                n = np.bincount(token.view(np.int64), minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.array([pack(words[rank.view(np.int64)[: min(most, len(n))]], n[:most], np.array([n.sum()]))], pa.binary())], names=["blob"])

    n, size = layout.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("blob")), F.lit(0))).first()
    part = F.pmod(F.xxhash64("block"), F.lit(max(1, n // blocks)))
    parts = [unpack(r[0]) for r in layout.where(part == 0).select("blob").mapInArrow(run, "blob binary").collect()]
    if not parts:
        return size, np.zeros(0, U64), np.zeros(0)
    words, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    count = np.bincount(inverse, np.concatenate([p[1] for p in parts]).view(np.int64))
    top = np.argsort(-count, kind="stable")[:most]
    return size, words[top], count[top] / sum(int(p[2][0]) for p in parts)


def _requests(shards: int, frequent: np.ndarray, hot: Hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                b = _Block(blob.as_py())
                route = _Route(b, shards, hot)
                short = np.searchsorted(frequent, b.words)
                known = np.zeros(len(b.words), bool)
                inside = short < len(frequent)
                known[inside] = frequent[short[inside]] == b.words[inside]
                to, blobs = [], []
                place, at_first = np.empty(len(b.words), np.int32), np.empty(len(b.words), np.int32)
                at_two = np.empty(len(b.w2a), np.int32)
                at_two[route.order2] = np.arange(len(b.w2a), dtype=np.int32)
                for s in range(shards):
                    lo, hi = route.one[s : s + 2]
                    guest = route.guest[route.guests[s] : route.guests[s + 1]]
                    if lo == hi and not len(guest):
                        continue
                    before = guest[guest < lo]
                    first = np.concatenate([before, np.arange(lo, hi), guest[len(before) :]])
                    two, three = route.order2[route.two[s] : route.two[s + 1]], route.order3[route.three[s] : route.three[s + 1]]
                    second, third = b.w2b[two], b.w3c[three]
                    used = np.zeros(len(b.words), bool)
                    used[second] = True
                    used[third] = True
                    child = np.flatnonzero(used)
                    child = np.concatenate([child[known[child]], child[~known[child]]])  # named by number, then by hash
                    place[child] = np.arange(len(child), dtype=np.int32)
                    few = int(known[child].sum())
                    at_first[first] = np.arange(len(first), dtype=np.int32)
                    fan2 = np.bincount(at_first[b.w2a[two]], minlength=len(first))
                    fan3 = np.bincount(at_two[b.n3[three]] - route.two[s], minlength=len(two))
                    head = np.array([len(before), hi - lo])
                    to.append(s)
                    blobs.append(pack(head, b.words[first], b.c1[first], fan2, place[second], b.c2[two], fan3, place[third], b.c3[three], short[child[:few]], b.words[child[few:]]))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([block] * len(to), pa.string()), pa.array(blobs, pa.binary())], names=["shard", "block", "blob"])

    return run


class _Request:
    """A block's request to a shard; its words become places in the shard's list of words."""

    def __init__(self, blob: bytes):
        small = lambda x: x.view(np.int64).astype(np.int32)
        head, own, c1, fan2, second, c2, fan3, third, c3, named, others = unpack(blob)
        before, n = (int(x) for x in head)
        self.mine = slice(before, before + n)  # the words that are the shard's own, not guests
        self.own, self.named, self.others = own, small(named), others
        self.c1, self.fan2, self.second, self.c2, self.fan3, self.third, self.c3 = map(small, (c1, fan2, second, c2, fan3, third, c3))

    def place(self, words: np.ndarray, at_frequent: np.ndarray) -> None:
        """at_frequent: places of the frequent words that any request names."""
        self.first = np.searchsorted(words, self.own).astype(np.int32)
        child = np.concatenate([at_frequent[self.named], np.searchsorted(words, self.others).astype(np.int32)])
        self.second, self.third = child[self.second], child[self.third]
        self.own = self.named = self.others = None

    def key2(self) -> np.ndarray:
        return np.repeat(self.first, self.fan2).astype(np.int64) << 32 | self.second


def _expected(back: np.ndarray, mu: float) -> np.ndarray:
    """Code + 1 of the probability of a single occurrence after a context, from the code + 1 of its back-off."""
    return quantise(restore(np.maximum(back, 1) - 1) - np.log10(mu)).astype(np.int64) + 1


def _relative(code: np.ndarray, back: np.ndarray, mu: float) -> np.ndarray:
    """Codes as small numbers: their distance from what the context leads to expect, 0 for absent."""
    d = code - _expected(back, mu)
    return np.where(code > 0, (d << 1 ^ d >> 63) + 1, 0)


def _absolute(sent: np.ndarray, back: np.ndarray, mu: float) -> np.ndarray:
    d = sent - 1
    return np.where(sent > 0, (d >> 1 ^ -(d & 1)) + _expected(back, mu), 0)


class Trie:
    """A shard of the model: words, bigrams and trigrams that start with one of its words."""

    def __init__(self, ctx1: np.ndarray, key2: np.ndarray, c2: np.ndarray, key3: np.ndarray, c3: np.ndarray, mu: float, mapped: Mapped):
        """ctx1: counts of the words; key2: (word, successor), key3: (place in key2, successor), both packed and ascending."""
        low, n = 0xFFFFFFFF, len(ctx1)
        first, node = key2 >> 32, key3 >> 32
        ctx2 = np.bincount(node, c3, len(key2))
        self.mu = mu
        self.back1 = mapped.array(quantise(np.log10(mu / (ctx1 + mu))))
        self.two = mapped.level(Level(np.bincount(first, minlength=n), key2 & low, n, prob=np.log10(c2 / (ctx1[first] + mu)), back=np.log10(mu / (ctx2 + mu))))
        self.three = mapped.level(Level(np.bincount(node, minlength=len(key2)), key3 & low, n, prob=np.log10(c3 / (ctx2[node] + mu))))

    def look_up(self, r: _Request) -> list[np.ndarray]:
        """Back of words, prob and back of bigrams, prob of trigrams: codes + 1 (0: absent), probs relative to their context's back."""
        two = self.two.find(np.repeat(r.first, r.fan2), r.second)
        three = self.three.find(np.repeat(two, r.fan3), r.third)

        def codes(values: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.where(at >= 0, values[np.maximum(at, 0)].astype(np.int64) + 1, 0) if len(values) else np.zeros(len(at), np.int64)

        back1, back2 = codes(self.back1, r.first), codes(self.two.codes["back"], two)
        prob2 = _relative(codes(self.two.codes["prob"], two), np.repeat(back1, r.fan2), self.mu)
        prob3 = _relative(codes(self.three.codes["prob"], three), np.repeat(back2, r.fan3), self.mu)
        return [back1, prob2, back2, prob3]


def _sum_by(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys that occur, ascending, with their summed counts."""
    seen = count > 0
    key, count = key[seen], count[seen]
    if not len(key):
        return key, count
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[at], np.add.reduceat(count[order], at)


def _answer(mu: float, frequent: np.ndarray):
    """All blocks' requests to a shard: build its trie, look every request up in it."""

    def run(group: pa.Table) -> pa.Table:
        requests = [_Request(b.as_py()) for b in group.column("blob")]
        # Named children are gathered as marks, not as hashes of every block.
        named = np.zeros(len(frequent), bool)
        for r in requests:
            named[r.named] = True
        words = np.unique(np.concatenate([frequent[named], *(x for r in requests for x in (r.own, r.others))]))
        at_frequent = np.searchsorted(words, frequent).astype(np.int32)
        c1, mine = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        for r in requests:
            r.place(words, at_frequent)
            c1[r.first] += r.c1
            mine[r.first[r.mine]] = True
        key2, c2 = _sum_by(np.concatenate([r.key2() for r in requests]), np.concatenate([r.c2 for r in requests]))
        key3 = [np.repeat(np.searchsorted(key2, r.key2()), r.fan3) << 32 | r.third for r in requests]
        # A bigram that no training text has keeps no successors: its trigrams have count 0 too.
        key3, c3 = _sum_by(np.concatenate(key3), np.concatenate([r.c3 for r in requests]))
        own, n = c1[mine], len(requests)
        with Mapped() as mapped:
            trie = Trie(c1, key2, c2, key3, c3, mu, mapped)
            del key2, c2, key3, c3
            answers = []
            for r in requests:
                back1, *rest = trie.look_up(r)
                answers.append(pack(c1[r.first[r.mine]], *(x for codes in (back1[r.mine], *rest) for x in ranked(codes))))
            del trie
        return pa.table({
            "shard": group.column("shard"), "block": group.column("block"), "answer": pa.array(answers, pa.binary()),
            "types": pa.array([int((own > 0).sum())] * n, pa.int64()), "tokens": pa.array([int(own.sum())] * n, pa.int64()),
        })

    return run


def _score(mu: float, shards: int, hot: Hot, types: int, tokens: int):
    def run(key: tuple, layout: pa.Table, answers: pa.Table) -> pa.Table:
        out = _score_block(layout, answers, mu, shards, hot, types, tokens)
        release()
        return out

    return run


def _score_block(layout: pa.Table, answers: pa.Table, mu: float, shards: int, hot: Hot, types: int, tokens: int) -> pa.Table:
    order = np.argsort(answers.column("shard").to_numpy())
    parts = [[c.view(np.int64) for c in unpack(answers.column("answer")[int(i)].as_py())] for i in order]
    b = _Block(layout.column("blob")[0].as_py())
    route = _Route(b, shards, hot)
    c1 = np.concatenate([p[0] for p in parts])
    back1, *sent = (np.concatenate([p[k][p[k + 1]] for p in parts]) for k in (1, 3, 5, 7))
    del parts
    prob2, back2, prob3 = (np.empty_like(x) for x in sent)
    for x, y, order in zip((prob2, back2, prob3), sent, (route.order2, route.order2, route.order3)):
        x[order] = y
    del route, sent
    value = lambda code, absent: np.where(code > 0, 10.0 ** restore(code - 1), absent)
    prob2 = value(_absolute(prob2, back1[b.w2a], mu), 0.0)
    prob3 = value(_absolute(prob3, back2[b.n3], mu), 0.0)
    back1, back2 = value(back1, 1.0), value(back2, 1.0)

    p = ((c1 + 1) / (tokens + types + 1))[b.token]
    base = np.log10(p)
    p[b.at2 + 1] = prob2[b.of2] + back1[b.w2a][b.of2] * p[b.at2 + 1]
    p[b.at3 + 2] = prob3[b.of3] + back2[b.n3][b.of3] * p[b.at3 + 2]
    add = lambda x: np.add.reduceat(x, b.first) if len(b.first) else x[:0]
    return pa.table(
        {
            "doc_id": pa.array(b.ids, pa.int64(), mask=b.null.astype(bool)),
            "n_tokens": pa.array(b.lengths),
            "n_known": pa.array(add((c1[b.token] > 0).astype(np.int64))),
            "train_tokens": pa.array(np.full(len(b.ids), tokens)),
            "base_score": pa.array(add(base)),
            "score": pa.array(add(np.log10(p))),
            "train": pa.array(b.train.astype(bool)),
        }
    )


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", mu: float = MU, shards: int | None = None, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Every row of docs scored by the model of the rows where the column ``train`` is true.

    doc_id, n_tokens, n_known, train_tokens (long), base_score (unigrams), score (trigrams), train.
    The tables that the result reads stay in the shared folder.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    layout = written(rows.mapInArrow(tidy_batches(_layout(block_bytes)), "block string, blob binary"), "layout")
    size, words, share = _sampled(layout)
    shards = shards or max(2 * n_partitions(docs.sparkSession), -(-size // shard_bytes))
    frequent, hot = np.sort(words), Hot(words, share, shards)
    asked = layout.mapInArrow(tidy_batches(_requests(shards, frequent, hot)), "shard int, block string, blob binary")
    answers = written(asked.groupBy("shard").applyInArrow(tidy(_answer(mu, frequent)), "shard int, block string, answer binary, types long, tokens long"), "answers")
    one = answers.groupBy("shard").agg(F.max("types").alias("types"), F.max("tokens").alias("tokens"))
    types, tokens = (int(x or 0) for x in one.agg(F.sum("types"), F.sum("tokens")).first())
    kind = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, train boolean"
    return layout.groupBy("block").cogroup(answers.select("shard", "block", "answer").groupBy("block")).applyInArrow(_score(mu, shards, hot, types, tokens), kind)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id")
    held = fold("doc_id", 7) == 2
    out = score(docs, ~held)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op4_lm_scoring": op4_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
