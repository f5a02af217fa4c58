"""Quality rules as a short-circuit cascade.

Each rule rejects a text by one measurement.  On a sample the cascade measures what a rule
costs and what share of texts it rejects, orders the rules by rejection per cost, and then
evaluates a rule only on the texts that every earlier rule passed.  The verdict is the
conjunction of all rules, so the order changes cost and never a verdict; only ``rejected_by``, the
rule that came first, depends on it.

The sample is the first ``sample_rows`` texts of each task, so it takes no reading of its own, and a
partition from one source gets an order that suits it.

Defined results: a null or empty text has no words and is rejected by ``few_words``; rows are
judged one by one, so repeated rows and null ids each get their own verdict; very long texts are
measured whole; an empty table gives an empty result; other columns, whatever their names, are not
read by ``judge`` and pass ``keep`` unchanged.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table
from .wordhash import BLANK, U64, mix, ngram_hashes, slices, text_bytes, word_hashes, word_spans

SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _bytes_in(members) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_SYMBOL = _bytes_in(SYMBOLS)
_UPPER = _bytes_in(range(65, 91))
_ASCII_LETTER = _UPPER | _bytes_in(range(97, 123))
_LETTER = _ASCII_LETTER | _bytes_in(range(128, 256))
_CODE_POINT = ~_bytes_in(range(128, 192))


class Texts:
    """Measurements of a run of texts; each is computed once, when first asked for."""

    def __init__(self, raw: bytes, offsets: np.ndarray):
        self.raw, self.offsets, self.n = raw, offsets, len(offsets) - 1

    def take(self, keep: np.ndarray) -> Texts:
        if keep.all():
            return self
        lengths = np.diff(self.offsets)[keep]
        raw = b"".join(self.raw[self.offsets[i] : self.offsets[i + 1]] for i in np.flatnonzero(keep))
        return Texts(raw, np.concatenate([[0], np.cumsum(lengths)]))

    @cached_property
    def _data(self) -> np.ndarray:
        return np.frombuffer(self.raw, np.uint8)

    def count(self, members: np.ndarray) -> np.ndarray:
        """Bytes of each text that are in the table."""
        return self._sums(members[self._data])

    def _sums(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    @cached_property
    def _spans(self):
        return word_spans(self.raw, self.offsets)

    @property
    def n_words(self) -> np.ndarray:
        return self._spans[2]

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.count(_CODE_POINT & ~BLANK)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.count(_SYMBOL)

    @cached_property
    def n_upper(self) -> np.ndarray:
        return self.count(_UPPER)

    @cached_property
    def n_ascii_letters(self) -> np.ndarray:
        return self.count(_ASCII_LETTER)

    @cached_property
    def n_letter_words(self) -> np.ndarray:
        """Words with an ASCII letter or a character beyond ASCII."""
        starts, ends, counts = self._spans
        total = np.concatenate([[0], np.cumsum(_LETTER[self._data], dtype=np.int64)])
        return _per_text((total[ends] > total[starts]).astype(np.int64), counts)

    @cached_property
    def _lines(self) -> np.ndarray:
        out = np.zeros((self.n, 2), np.int64)
        for i in range(self.n):
            seen: set[bytes] = set()
            for line in self.raw[self.offsets[i] : self.offsets[i + 1]].split(b"\n"):
                if line and not line.isspace():
                    out[i, 0] += 1
                    out[i, 1] += line in seen
                    seen.add(line)
        return out

    @property
    def n_lines(self) -> np.ndarray:
        return self._lines[:, 0]

    @property
    def n_dup_lines(self) -> np.ndarray:
        return self._lines[:, 1]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        starts, ends, counts = self._spans
        hashes = word_hashes(self.raw, starts, ends)
        text = np.repeat(np.arange(self.n), counts)
        grams = ngram_hashes(hashes, 3)
        at = np.flatnonzero(text[: len(grams)] == text[2:]) if len(grams) else np.zeros(0, np.int64)
        key = mix(grams[at] ^ mix(text[at].astype(U64) + U64(1)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        covered = np.zeros(len(hashes), np.int64)
        for k in range(3):
            covered[at[again] + k] = 1
        return _per_text(covered, counts)


def _per_text(flags: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


@dataclass(frozen=True)
class Rule:
    """rejects: from the measurements of some texts, which of them the rule rejects."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


def default_rules(
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_symbol_percent: int = 10,
    max_dup_line_percent: int = 50,
    max_upper_percent: int = 50,
    min_letter_word_percent: int = 60,
    mean_word_chars: tuple[int, int] = (2, 20),
) -> list[Rule]:
    """Integer arithmetic only, so that an oracle reproduces every verdict exactly."""
    low, high = mean_word_chars
    return [
        Rule("few_words", lambda t: t.n_words < min_words),
        Rule("repeated_words", lambda t: 100 * t.n_repeat_words > max_repeat_percent * t.n_words),
        Rule("symbols", lambda t: 100 * t.n_symbols > max_symbol_percent * t.n_words),
        Rule("repeated_lines", lambda t: 100 * t.n_dup_lines > max_dup_line_percent * t.n_lines),
        Rule("capitals", lambda t: 100 * t.n_upper > max_upper_percent * t.n_ascii_letters),
        Rule("words_without_letters", lambda t: 100 * t.n_letter_words < min_letter_word_percent * t.n_words),
        Rule("word_length", lambda t: (t.word_chars < low * t.n_words) | (t.word_chars > high * t.n_words)),
    ]


BASE_RULES = ("few_words", "repeated_words")


def order_rules(rules: list[Rule], raw: bytes, offsets: np.ndarray) -> list[Rule]:
    """The rules by falling rejection per cost, both measured on some texts; without a text the given order stays."""
    n = len(offsets) - 1
    if not n:
        return list(rules)
    rate = []
    for rule in rules:
        texts = Texts(raw, offsets)
        began = time.perf_counter_ns()
        hits = int(rule.rejects(texts).sum())
        rate.append((hits + 1) / (n + 2) / max(time.perf_counter_ns() - began, 1))
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-rate[i], i))]


class Ordered:
    """A task's rules: in the given order until its first texts have come, then by rejection per cost."""

    def __init__(self, rules: list[Rule], sample_rows: int):
        self.rules, self.sample_rows = list(rules), sample_rows

    def see(self, column: pa.Array) -> None:
        if self.sample_rows and len(column):
            self.rules = order_rules(self.rules, *text_bytes(column.slice(0, self.sample_rows)))
            self.sample_rows = 0


def cascade(texts: Texts, rules: list[Rule]) -> np.ndarray:
    """Index of the rule that rejects each text, -1 for kept; later rules see survivors only."""
    verdict = np.full(texts.n, -1)
    alive = np.arange(texts.n)
    for k, rule in enumerate(rules):
        if not len(alive):
            break
        bad = rule.rejects(texts)
        verdict[alive[bad]] = k
        texts, alive = texts.take(~bad), alive[~bad]
    return verdict


def judge(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 64) -> DataFrame:
    """id, the base measurements, base_failed, kept, and rejected_by (the rule's name) of every row."""
    rules = default_rules() if rules is None else rules
    base = [r for r in rules if r.name in BASE_RULES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The base measurements are asked for anyway; the others' rules are put in order.
        own = Ordered([r for r in rules if r.name not in BASE_RULES], sample_rows)
        for batch in batches:
            for part in slices(batch, text_col):
                own.see(part.column(1))
                rest = own.rules
                texts = Texts(*text_bytes(part.column(1)))
                stats = [getattr(texts, c) for c in BASE]
                by = np.array(["", *(r.name for r in base)], object)[cascade_shared(texts, base) + 1]
                open_ = by == ""
                later = np.array(["", *(r.name for r in rest)], object)[cascade(texts.take(open_), rest) + 1]
                failed = ~open_
                by[open_] = later
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(s, pa.int64()) for s in stats), pa.array(failed), pa.array(by == ""), pa.array([x or None for x in by], pa.string())],
                    names=[id_col, *BASE, "base_failed", "kept", "rejected_by"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, kept boolean, rejected_by string"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def cascade_shared(texts: Texts, rules: list[Rule]) -> np.ndarray:
    """The cascade where every measurement is already there: nothing is gained by subsets."""
    verdict = np.full(texts.n, -1)
    for k, rule in enumerate(rules):
        verdict[(verdict < 0) & rule.rejects(texts)] = k
    return verdict


def keep(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample_rows: int = 64) -> DataFrame:
    """The rows that pass every rule, all columns unchanged; the cascade stops at the first rejection."""
    rules = default_rules() if rules is None else rules
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordered(rules, sample_rows)
        for batch in batches:
            for part in slices(batch, text_col):
                own.see(part.column(at))
                yield part.filter(pa.array(cascade(Texts(*text_bytes(part.column(at))), own.rules) < 0))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents", "doc_id")).drop("rejected_by")


QUERIES = {"op7_quality_rules": op7_quality_rules}

_WORD = r"[^\x20\x09-\x0D]+"
ORACLE_SQL = {
    "op7_quality_rules": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ln
  FROM documents),
grams AS (
  SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
again AS (
  SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(ln) - len(list_distinct(ln)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         len(ln) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS up, len(regexp_extract_all(t, '[A-Za-z]')) AS le,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS lw
  FROM d LEFT JOIN covered USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words
            OR 100 * n_dup_lines > 50 * n_lines OR 100 * up > 50 * le OR 100 * lw < 60 * n_words
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM m"""
}
