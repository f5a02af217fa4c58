"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are all lower-cased words of the examples; a word of more than ``LONG`` bytes (a script
without blanks) also gives its character 5-grams.  A term's TF-IDF weight is multiplied by what it
says about the label (chi-square over the examples, 0 to 1, plus ``LEAST``), so no term is left
out and the telling ones decide.  Examples are sorted so that similar ones are neighbours and cut
into blocks of 64.  The index keeps, for each term, its postings by block and the largest weight
in each block.  A query visits blocks in the order of the bound that those maxima give on its
cosine, and leaves out those that cannot beat the k-th best found; so the k nearest are exact.
Equal similarities are won by the example whose text comes first in byte order.

Neighbours vote with weight 1 / (1.05 - cosine).  The share of toxic votes is calibrated by a
logistic fit on votes that know nothing of the voted example's label: the examples are dealt into
``FOLDS`` parts, and each part is voted on by an index, term weights included, of the others.  Each
class is weighted by its true number, and every score comes with its nearest examples as evidence.

The examples are a bounded sample: ``per_class`` labelled documents of each label (1,000).
Scoring is one narrow pass over whole texts with the index in the closure; its size is bounded
by the terms of 2 * per_class examples.

Defined results: a text without any indexed term, a null or an empty text has no neighbours and
gets the examples' rate among such texts; repeated rows are scored one by one; an id that the
documents have with several texts is one example with the largest of them; very long texts are
scored whole; columns besides the id, the text and the label are not read, whatever their names;
an empty table gives an empty result; without any usable label every score is 0.5.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .calibration import Logistic, labelled_sample
from .tables import fold, table

GRAM, LONG, BLOCK, THRESHOLD, LEAST, FOLDS = 5, 24, 64, 0.7, 1e-3, 4
_WORDS = bytes(32 if c < 128 and not chr(c).isalnum() else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> Counter[bytes]:
    return Counter(text.encode("utf-8", "surrogatepass").translate(_WORDS).split()) if text else Counter()


def terms_of(word: bytes) -> list[bytes]:
    """The word itself and, of a long one, each of its character n-grams once, marked."""
    if len(word) <= LONG:
        return [word]
    w = word.decode("utf-8", "replace")
    return [word, *(b"~" + g.encode("utf-8", "replace") for g in dict.fromkeys(w[i : i + GRAM] for i in range(len(w) - GRAM + 1)))]


def _spans(start: np.ndarray, end: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges [start, end) in one array, and the weight of the range each is from."""
    n = end - start
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n), np.repeat(weight, n)


class BlockMaxIndex:
    """Exact top-k cosine over sparse unit vectors (term number -> weight); equal ones in the order given."""

    def __init__(self, ids: list[int], vectors: list[dict[int, float]], n_terms: int):
        first = [min(v, key=lambda t: (-v[t], t)) if v else n_terms for v in vectors]
        order = sorted(range(len(ids)), key=lambda i: (first[i], i))
        self.order = np.array(order, np.int64)
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.n_blocks = -(-len(ids) // BLOCK)
        sizes = [len(vectors[i]) for i in order]
        term = np.fromiter((t for i in order for t in vectors[i]), np.int64, sum(sizes))
        weight = np.fromiter((w for i in order for w in vectors[i].values()), float, sum(sizes))
        at = np.repeat(np.arange(len(order)), sizes)
        by = np.lexsort((at, term))
        term, self.at, self.weight = term[by], at[by], weight[by]
        # An entry is a term's postings within one block.
        block = self.at // BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        start = np.flatnonzero(new)
        self.cut = np.append(start, len(term))
        self.block = block[start]
        self.most = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        self.entries = np.searchsorted(term[start], np.arange(n_terms + 1))

    def nearest(self, query: dict[int, float], k: int, skip: int | None = None) -> list[tuple[float, int]]:
        """(cosine, position) of the k nearest with cosine > 0, nearest first; skip: an id to leave out."""
        terms = sorted(query)
        return self.nearest_to(np.array(terms, np.int64), np.array([query[t] for t in terms]), k, skip)

    def nearest_to(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int | None = None) -> list[tuple[float, int]]:
        """The same for a query given as rising term numbers and their weights."""
        entry, w = _spans(self.entries[terms], self.entries[terms + 1], weights)
        block = self.block[entry]
        bound = np.bincount(block, w * self.most[entry], self.n_blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        score, least, step = np.zeros(self.n_blocks * BLOCK), 0.0, 4
        while len(order):
            # The most promising blocks first, then all that can still beat the k-th best.
            now = np.zeros(self.n_blocks, bool)
            now[order[:step]] = True
            chosen = now[block]
            of = entry[chosen]
            post, weight = _spans(self.cut[of], self.cut[of + 1], w[chosen])
            score += np.bincount(self.at[post], weight * self.weight[post], len(score))
            if skip is not None:
                score[: len(self.ids)][self.ids == skip] = 0
            if np.count_nonzero(score) >= k:
                least = np.partition(score, -k)[-k]
            order, step = order[step:], self.n_blocks
            order = order[bound[order] >= least - 1e-8]
        found = np.flatnonzero((score > 0) & (score >= least - 1e-8))
        cosine = np.round(np.minimum(score[found], 1.0), 9)
        best = np.lexsort((self.order[found], -cosine))[:k]
        return list(zip(cosine[best].tolist(), found[best].tolist()))


class Examples:
    """The index of some labelled examples (id, word counts, label) and their terms' weights."""

    def __init__(self, sample: list[tuple[int, Counter[bytes], int]]):
        labels = np.array([y for *_, y in sample], np.int64)
        n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
        df: tuple[Counter, Counter] = (Counter(), Counter())
        for _, c, y in sample:
            df[y].update({t for w in c for t in terms_of(w)})
        every = sorted(set(df[0]) | set(df[1]))
        self.terms = {t: i for i, t in enumerate(every)}
        a, b = (np.array([d[t] for t in every], float) for d in (df[1], df[0]))
        below = (a + b) * (n0 + n1 - a - b) * n1 * n0
        says = np.divide((a * (n0 - b) - b * (n1 - a)) ** 2, below, out=np.zeros(len(every)), where=below > 0)
        self.weight = (says + LEAST) * (np.log((1 + len(sample)) / (1 + a + b)) + 1)
        vectors = [self.vector(c) for _, c, _ in sample]
        self.index = BlockMaxIndex([i for i, *_ in sample], [dict(zip(t.tolist(), w.tolist())) for t, w in vectors], len(every))
        self.toxic = labels[self.index.order] if len(sample) else labels

    def vector(self, counts: Counter[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Unit weighted TF-IDF vector: rising term numbers and their weights."""
        terms = self.terms
        found, times = [], []
        for w, n in counts.items():
            if len(w) > LONG:
                known = [terms[t] for t in terms_of(w) if t in terms]
                found += known
                times += [n] * len(known)
            elif (t := terms.get(w)) is not None:
                found.append(t)
                times.append(n)
        t, of = np.unique(np.array(found, np.int64), return_inverse=True)
        out = (1 + np.log(np.bincount(of, times, len(t)))) * self.weight[t]
        return t, out / np.sqrt(out @ out) if len(out) else out

    def nearest(self, counts: Counter[bytes], k: int) -> list[tuple[float, int]]:
        vector = self.vector(counts)
        return self.index.nearest_to(*vector, k) if len(vector[0]) else []

    def vote(self, near: list[tuple[float, int]]) -> float | None:
        if not near:
            return None
        w = np.array([1 / (1.05 - s) for s, _ in near])
        return float(w @ self.toxic[[at for _, at in near]] / w.sum())


class ToxicityModel:
    def __init__(self, sample: list[tuple[int, str, int]], totals: dict[int, int], k: int = 15):
        self.k = k
        sample = [(i, words_of(text), y) for i, text, y in sorted(sample, key=lambda x: (x[1].encode("utf-8", "surrogatepass"), x[2]))]
        labels = np.array([y for *_, y in sample], np.int64)
        self.examples = Examples(sample)
        votes: list[float | None] = [None] * len(sample)
        for f in range(FOLDS):
            others = Examples([x for j, x in enumerate(sample) if j % FOLDS != f])
            for j in range(f, len(sample), FOLDS):
                votes[j] = others.vote(others.nearest(sample[j][1], k))
        rate = {y: totals.get(y, 0) / max(1, int((labels == y).sum())) for y in (0, 1)}
        weight = np.array([rate[int(y)] for y in labels])
        some = np.array([v is not None for v in votes], bool)
        self.without = float((weight[~some] @ labels[~some] + 0.5) / (weight[~some].sum() + 1)) if len(sample) else 0.5
        self.calibrate = Logistic(np.array([v for v in votes if v is not None]), labels[some], weight[some])

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        near = self.examples.nearest(words_of(text), self.k)
        vote = self.examples.vote(near)
        return (self.without if vote is None else float(self.calibrate([vote])[0])), near


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = 1000, k: int = 15, parts: int = 3, held: int = 1) -> ToxicityModel:
    return ToxicityModel(*labelled_sample(docs, labels, label_col, parts, held, per_class), k)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", n_evidence: int = 3) -> DataFrame:
    """id, score, evidence (nearest examples: doc_id, cosine, toxic) of every row."""
    known = model.examples
    item = pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, evidence = [], []
            for text in b.column(1):
                s, near = model.score(text.as_py())
                scores.append(s)
                evidence.append([{"doc_id": int(known.index.ids[at]), "cosine": c, "toxic": int(known.toxic[at])} for c, at in near[:n_evidence]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(item))], names=[id_col, "score", "evidence"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, evidence array<struct<doc_id:long,cosine:double,toxic:int>>")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLE_SQL: dict[str, str] = {}
