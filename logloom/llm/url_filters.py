r"""URL filters as a sort-merge range join.

A rule is a host and a path prefix; it fits a url of that host or of a subdomain whose path
starts with the rule's.  Hosts are turned into reversed-label keys (``www.example.com`` is
``com.example.www.``), under which a host and its subdomains are one interval of the sorted
order.  Every Arrow batch of urls is sorted by that key and swept once against the sorted
rules; a stack holds the rules whose interval contains the present key, innermost last, and
the longest fitting rule on the stack wins (at equal length the one of the longer host).  From one
key to the next the sweep leaps over the rules between by bisection: a rule below the present key
that does not contain it contains no later key either.  So a batch costs its own rows, however
many rules there are.

Urls are never shuffled, so a host with a third of all rows costs nothing extra.  Rules are
read in blocks of at most ``block_rules`` (by a hash of the rule), each shipped with the task
closure, and every further block is one more pass over (id, url, best rule so far).

Defined results: a null url, or one without ``://``, has empty host and path and fits no rule;
a url that fits none gets rule null and the default verdict; repeated rules with different
verdicts resolve to ``block``; repeated rows are judged one by one; very long urls are split whole;
an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .tables import table

_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        """``example.com/en/``: host up to the first slash, then the path."""
        host, slash, path = text.partition("/")
        return cls(verdict, host.translate(_LOWER), slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = tuple(
    Rule.parse(*r)
    for r in (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
)


def split_url(url: str | None) -> tuple[str, str]:
    found = _URL.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def host_key(host: str) -> str:
    """Reversed labels, each closed by \\x00 so that no label is a prefix of another."""
    return "".join(f"{x}\0" for x in reversed(host.split(".")))


def _blocks(rules: Iterable[Rule], block_rules: int) -> list[list[tuple[str, list[tuple[str, str, str, int]]]]]:
    """Rules by host key, sorted; of each host, paths by falling length."""
    best: dict[tuple[str, str], str] = {}
    for r in rules:
        best[r.host, r.path] = "block" if "block" in (r.verdict, best.get((r.host, r.path))) else r.verdict
    every = sorted(best)
    out = []
    for at in range(0, len(every), block_rules):
        hosts: dict[str, list[tuple[str, str, str, int]]] = {}
        for host, path in every[at : at + block_rules]:
            hosts.setdefault(host_key(host), []).append((path, host + path, best[host, path], len(host)))
        out.append(sorted((k, sorted(v, key=lambda x: -len(x[0]))) for k, v in hosts.items()))
    return out


_first = itemgetter(0)


def sweep(keyed: list[tuple[str, str, int]], rules: list[tuple[str, list[tuple[str, str, str, int]]]]) -> Iterator[tuple[int, str, str, int]]:
    """For sorted (host key, path, row), the row, rule text, verdict and host length of the longest fit."""
    stack: list[tuple[str, list[tuple[str, str, str, int]]]] = []
    at, before = 0, None
    for key, path, row in keyed:
        if key != before:
            before = key
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            to = bisect_right(rules, key, at, key=_first)
            if to > at:
                # Rules that contain the key are among its label prefixes; those up to the stack's top are there already.
                end = len(stack[-1][0]) if stack else 0
                while end < len(key):
                    end = key.index("\0", end) + 1
                    k = bisect_left(rules, key[:end], at, to, key=_first)
                    if k < to and rules[k][0] == key[:end]:
                        stack.append(rules[k])
            at = to
        found = None
        for _, paths in reversed(stack):
            for start, text, verdict, size in paths:
                if path.startswith(start):
                    if found is None or (len(text), size) > (len(found[0]), found[2]):
                        found = (text, verdict, size)
                    break
        if found:
            yield row, *found


def judge_urls(urls: DataFrame, rules: Iterable[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow", block_rules: int = 200_000) -> DataFrame:
    """id, host, path, rule, verdict of every row; one narrow pass for each block of rules."""
    blocks = _blocks(rules, block_rules) or [[]]
    kind = urls.schema[id_col].dataType.simpleString()
    names = [id_col, "host", "path", "rule", "verdict", "host_len"]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.array([0] * n, pa.int32())],
                names=names,
            )

    def merge(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hosts, paths, rule, verdict, size = (b.column(i).to_pylist() for i in range(1, 6))
                keyed = sorted((host_key(h), p, i) for i, (h, p) in enumerate(zip(hosts, paths)) if h)
                for i, text, said, length in sweep(keyed, block):
                    if rule[i] is None or (len(text), length) > (len(rule[i]), size[i]):
                        rule[i], verdict[i], size[i] = text, said, length
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(size, pa.int32())], names=names)

        return run

    schema = f"`{id_col}` {kind}, host string, path string, rule string, verdict string, host_len int"
    out = urls.select(id_col, url_col).mapInArrow(first, schema)
    for block in blocks:
        out = out.mapInArrow(merge(block), schema)
    return out.fillna({"verdict": default}).drop("host_len")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages", "page_id"))


QUERIES = {"op10_url_filters": op10_url_filters}
ORACLE_SQL = {
    "op10_url_filters": r"""
WITH u AS (
  SELECT page_id, strpos(coalesce(url, ''), '://') AS k, coalesce(url, '') AS url FROM pages),
p AS (
  SELECT page_id, CASE WHEN k > 0 THEN regexp_extract(substr(url, k + 3), '^([^/?#]*)', 1) ELSE '' END AS raw,
         CASE WHEN k > 0 THEN regexp_extract(substr(url, k + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM u),
h AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
r(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                              ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(f.verdict, 'allow') AS verdict FROM h LEFT JOIN f USING (page_id)"""
}
