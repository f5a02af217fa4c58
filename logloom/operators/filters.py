"""Skip lists and the choice of interesting messages."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that are skipped by default.
DEFAULT_SKIP = (
    "$HASP*",
    "IEF196I",
    "IEF695I",
    "IEF285I",
    "IEF237I",
    "IGD103I",
    "IGD104I",
    "IRR010I",
    "ICH70001I",
    "IEF188I",
    "IEE042I",
    "IEF176I",
)
#: Message prefixes of general interest.
INTERESTING = (
    "IEF", "IEC", "IEA", "IEE", "IGD", "ICH", "IRR", "CSV", "IOS", "IGF", "IXC", "IXL", "ARC",
    "ADR", "DFH", "DSN", "CSQ", "IST", "EZA", "EZB", "EZY", "BPXF", "BPXM", "BPXP", "IKJ", "CRE",
)


@dataclass(frozen=True)
class SkipList:
    exact: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()

    @classmethod
    def parse(cls, lines: list[str]) -> SkipList:
        """One id a line; '#' starts a comment line, a trailing '*' makes a prefix."""
        items = [x for x in (line.strip(" \t\r\n") for line in lines) if x and not x.startswith("#")]
        return cls(tuple(x for x in items if not x.endswith("*")), tuple(x[:-1] for x in items if x.endswith("*")))

    def skips(self, msgid: Column) -> Column:
        """Whether the id is listed; an empty id never is."""
        hit = msgid.isin(*self.exact) if self.exact else F.lit(False)
        hit = reduce(lambda a, p: a | msgid.startswith(p), self.prefixes, hit)
        return (msgid != "") & hit


DEFAULT = SkipList.parse(list(DEFAULT_SKIP))


def load_skip_list(spark: SparkSession, path: str) -> SkipList:
    """The list in a file, which is written with the defaults where a local one does not exist."""
    if "://" not in path and not os.path.exists(path):
        with open(path, "w", encoding="utf-8") as f:
            f.write("# One message id a line; a trailing * matches by prefix; # starts a comment.\n" + "\n".join(DEFAULT_SKIP) + "\n")
    return SkipList.parse([r[0] for r in spark.read.text(path).collect()])


def drop_skipped(messages: DataFrame, skip: SkipList = DEFAULT, msgid: str = "msgid") -> DataFrame:
    return messages.where(~skip.skips(F.col(msgid)))


def drop_listed(messages: DataFrame, entries: DataFrame, msgid: str = "msgid") -> DataFrame:
    """Like drop_skipped for a skip list that is itself a table (pattern); exact ids by hash join, prefixes by range."""
    p = entries.select(F.trim("pattern").alias("pattern")).where("pattern != '' AND pattern NOT LIKE '#%'")
    exact = p.where(~F.col("pattern").endswith("*")).select(F.col("pattern").alias("__p"))
    out = messages.join(exact, F.col(msgid) == F.col("__p"), "left_anti")
    # A prefix of k characters matches by equality on the id's first k characters: one hash join.
    prefix = p.where(F.col("pattern").endswith("*")).select(F.expr("left(pattern, length(pattern) - 1)").alias("__p"))
    starts = messages.select(F.col(msgid).alias("__id")).distinct().where("__id != ''")
    starts = starts.withColumn("__s", F.explode(F.transform(F.sequence(F.lit(1), F.length("__id")), lambda k: F.substring("__id", F.lit(1), k))))
    hit = starts.join(prefix, F.col("__s") == F.col("__p"), "left_semi").select("__id").distinct()
    return out.join(hit, F.col(msgid) == F.col("__id"), "left_anti")


def interesting(messages: DataFrame, skip: SkipList = DEFAULT, verbose: bool = False, msgid: str = "msgid", severity: str = "severity") -> DataFrame:
    """Messages with an id that is not skipped and has severity A or E or a prefix of interest; verbose asks for an id only."""
    c = F.col(msgid)
    if verbose:
        return messages.where(c != "")
    return messages.where((c != "") & ~skip.skips(c) & (F.col(severity).isin("A", "E") | c.rlike(f"^(?:{'|'.join(INTERESTING)})")))
