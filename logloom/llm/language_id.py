"""Language by rank-order profiles of character n-grams.

A profile is the ``profile`` most frequent character 1- to 3-grams of a language's texts, words
padded with a blank on both sides, most frequent first (ties by code points).  A text's own
most frequent n-grams are ranked the same way; its out-of-place distance to a language adds,
over its n-grams, how far the ranks are apart, or ``profile`` for an n-gram that the language's
profile lacks.  The nearest language wins; equal distances are won by the first in sorted order.
The score is 1 / (1 + exp(-20 * margin)), margin being the runner-up's distance less the
winner's over the largest possible distance.

N-grams are packed integers, counted by sorting a text's own.  Profiles are learnt from a bounded
sample, the first ``per_language`` rows of each language (500) by the MD5 of their ids; only the
profiles reach the driver.  Profiles ship with the task closure in blocks of ``block_languages``; every
further block is one more pass that carries the two least distances found so far.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text
where no language could be learnt; with one language every other text has score 1 / (1 + exp(-20));
repeated rows are judged one by one; very long texts are counted whole; an empty table gives an empty
result; columns besides the id, the text and the language are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import discard, fold, table, written

PROFILE, UNKNOWN = 400, "und"
#: Nearest language, its distance, the next distance (None: there is no other).
Found = tuple[str, int, int | None]


@cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter; made once for each process."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct packed n-grams (21 bits a code point) of the lower-cased words, ascending, and their counts."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[c]
    # Words with one blank before, between and after: each blank pads the words on both its sides.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate([[32], np.where(letter, c, 32)[keep], [32]])
    if len(c) > 2 and c[-2] == 32:
        c = c[:-1]
    blank = c == 32
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    every = np.sort(np.concatenate([c[~blank], two[~(blank[:-1] & blank[1:])], three[~blank[1:-1]]]))
    at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    return every[at], np.diff(np.append(at, len(every)))


def ranked(gram: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by code."""
    if len(gram) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= least
        gram, counts = gram[keep], counts[keep]
    return gram[np.lexsort((gram, -counts))][:most]


class Profiles:
    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.profiles, self.languages, self.size = profiles, sorted(profiles), size
        every = np.unique(np.concatenate([profiles[k] for k in self.languages])) if profiles else np.zeros(0, np.int64)
        self.grams = every
        # rank of each known n-gram in each language; the last column stands for all others
        self.rank = np.full((len(self.languages), len(every) + 1), -1, np.int64)
        for i, k in enumerate(self.languages):
            self.rank[i, np.searchsorted(every, profiles[k])] = np.arange(len(profiles[k]))

    def blocks(self, languages: int) -> list[Profiles]:
        """The same in runs of so many languages, in order; one at least."""
        cuts = range(0, max(len(self.languages), 1), languages)
        return [Profiles({k: self.profiles[k] for k in self.languages[at : at + languages]}, self.size) for at in cuts]

    def distances(self, own: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        rank = self.rank[:, at]
        return np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own)))).sum(1)

    def nearest(self, own: np.ndarray, before: Found | None = None) -> Found | None:
        """The nearest language, its distance and the next distance, of these and those found before."""
        if not len(own) or not self.languages:
            return before
        d = self.distances(own)
        best = int(d.argmin())
        others = np.delete(d, best)
        found = self.languages[best], int(d[best]), int(others.min()) if len(others) else None
        if before is None:
            return found
        first, last = (before, found) if before[1] <= found[1] else (found, before)
        return first[0], first[1], last[1] if first[2] is None else min(first[2], last[1])

    def verdict(self, own: np.ndarray, found: Found | None) -> tuple[str, float]:
        if found is None:
            return UNKNOWN, 0.0
        margin = 1.0 if found[2] is None else (found[2] - found[1]) / (self.size * len(own))
        return found[0], float(1 / (1 + np.exp(-20 * margin)))

    def predict(self, own: np.ndarray) -> tuple[str, float]:
        return self.verdict(own, self.nearest(own))


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = 500, profile: int = PROFILE, parts: int = 4, held: int = 2) -> Profiles:
    """Profiles of every non-null language.  Reads the ids and languages once, then the texts once."""
    known = docs.where(F.col(lang_col).isNotNull() & (fold(id_col, parts) != held)).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    order = [F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), F.col("id")]
    few = known.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(16)))
    for keys in (["lang", "part"], ["lang"]):  # a language with a third of all rows is 16 groups first
        few = few.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("n") <= per_language)
    chosen = written(few.select("id", "lang").distinct(), "languages")
    # At most per_language rows a language; broadcast only while that is a small table.
    hint = F.broadcast if chosen.count() <= 1_000_000 else (lambda x: x)
    sample = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(hint(chosen), ["id", "lang"]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                gram, n = grams(text.as_py())
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(gram), "gram": gram, "n": n})

    counts = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    found: dict[str, list] = {}
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= profile).orderBy("lang", "rank").collect():
        found.setdefault(r["lang"], []).append(r["gram"])
    discard(chosen)
    return Profiles({k: np.array(v, np.int64) for k, v in found.items()}, profile)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", block_languages: int = 500) -> DataFrame:
    """id, lang_pred, score of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    state = f"`{id_col}` {kind}, text string, lang string, least long, next long"
    out = docs.select(F.col(id_col), F.col(text_col).alias("text"), *(F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("least", "long"), ("next", "long"))))
    *early, last = profiles.blocks(block_languages)

    def found_in(block: Profiles, b: pa.RecordBatch) -> list[tuple[np.ndarray, Found | None]]:
        before = zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))
        every = []
        for text, state_ in zip(b.column(1), before):
            own = ranked(*grams(text.as_py()), block.size)
            every.append((own, block.nearest(own, None if state_[0] is None else state_)))
        return every

    def carry(block: Profiles):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [f or (None, None, None) for _, f in found_in(block, b)]
                columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*b.columns[:2], *columns], names=b.schema.names)

        return run

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [last.verdict(*x) for x in found_in(last, b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], names=[id_col, "lang_pred", "score"])

    for block in early:
        out = out.mapInArrow(carry(block), state)
    return out.mapInArrow(finish, f"`{id_col}` {kind}, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id")
    out = identify(docs, fit(docs))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))


QUERIES = {"op6_language_id": op6_language_id}

_CRC32 = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda acc, b: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(acc, b)), 4294967295), 4294967295)"""
_CODE = """CASE length(g) WHEN 1 THEN CAST(unicode(g) AS BIGINT) WHEN 2 THEN (CAST(unicode(g) AS BIGINT) << 21) | unicode(substr(g, 2, 1))
  ELSE (CAST(unicode(g) AS BIGINT) << 42) | (CAST(unicode(substr(g, 2, 1)) AS BIGINT) << 21) | unicode(substr(g, 3, 1)) END"""
ORACLE_SQL = {
    "op6_language_id": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, lower(coalesce(text, '')) AS t, {_CRC32} % 4 = 2 AS held_out FROM documents),
p AS (SELECT rid, ' ' || unnest(regexp_extract_all(t, '\p{{L}}+')) || ' ' AS p FROM d),
g AS (SELECT rid, substr(p, i, k) AS g FROM p, (VALUES (1), (2), (3)) AS o(k), unnest(range(1, length(p) - k + 2)) AS u(i)),
c AS (SELECT rid, g, {_CODE} AS code, count(*) AS n FROM g WHERE g <> ' ' GROUP BY rid, g),
own AS (SELECT rid, code, row_number() OVER (PARTITION BY rid ORDER BY n DESC, code) - 1 AS r FROM c QUALIFY r < {PROFILE}),
few AS (SELECT rid, lang FROM d WHERE lang IS NOT NULL AND NOT held_out
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= 500),
tot AS (SELECT lang, code, sum(n) AS n FROM few JOIN c USING (rid) GROUP BY ALL),
pro AS (SELECT lang, code, row_number() OVER (PARTITION BY lang ORDER BY n DESC, code) - 1 AS r FROM tot QUALIFY r < {PROFILE}),
dist AS (
  SELECT rid, l.lang, sum(CASE WHEN pro.r IS NULL THEN {PROFILE} ELSE abs(pro.r - own.r) END) AS x, count(*) AS m
  FROM own CROSS JOIN (SELECT DISTINCT lang FROM pro) l LEFT JOIN pro ON pro.lang = l.lang AND pro.code = own.code GROUP BY ALL),
two AS (SELECT rid, lang, x, m, row_number() OVER (PARTITION BY rid ORDER BY x, lang) AS place, lead(x) OVER (PARTITION BY rid ORDER BY x, lang) AS nx FROM dist)
SELECT doc_id, held_out, coalesce(two.lang, '{UNKNOWN}') AS lang_pred,
       CASE WHEN x IS NULL THEN 0.0 ELSE round(1 / (1 + exp(-20 * CAST(coalesce((nx - x) / CAST({PROFILE} * m AS DOUBLE), 1) AS DOUBLE))), 6) END AS score
FROM d LEFT JOIN two ON two.rid = d.rid AND place = 1"""
}
