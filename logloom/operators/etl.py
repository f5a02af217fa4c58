"""Manual text extracted from PDF files to message and code entries.

Everything is line flags and running windows over (file, line_no); only the split of one
wildcard code's text into its sub-codes is a function of that text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

STANDALONE_ID = r"^([A-Z$#@]{2,8}[0-9]{1,5}[IEWADSX]?)\s*$"
INLINE_ID = r"^([A-Z$#@]{2,8}[0-9]{1,5}[IEWADSX]?)\s+(\S.*)$"

#: Page furniture of message manuals.
MESSAGE_NOISE = (
    r"^Chapter \d+\.\s+\w+ messages\s+\d+",
    r"^Chapter \d+\.\s",
    r"^\d+\s+z/OS:",
    r"^z/OS:\s",
    r"^©\s*Copyright",
    r"^IBM\s*$",
    r"^SA\d{2}-\d{4}",
    r"^\x0c",
    r"^z/OS$",
    r"^\d+\s*$",
    r"^Contents$",
    r"^Index$",
    r"^Notices\.*\s*\d*$",
    r"^Appendix [A-Z]\.",
    r"^About this document",
    r"^How to provide feedback",
    r"^Summary of changes",
    r"^Summary of message changes",
    r"^Message changes for",
    r"^\s*New$",
    r"^\s*Changed$",
    r"^\s*Deleted$",
    r"^The following messages are",
    r"^Who uses MVS",
)
#: Page furniture of the system-code manual.
CODE_NOISE = (
    r"^Chapter \d+\.\s+.*\d+$",
    r"^\d+\s+z/OS:",
    r"^z/OS:\s",
    r"^©\s*Copyright",
    r"^IBM\s*$",
    r"^SA\d{2}-\d{4}",
    r"^\x0c",
    r"^z/OS$",
    r"^Contents$",
    r"^Index$",
    r"^Notices\.*\s*\d*$",
    r"^Appendix [A-Z]\.",
    r"^About this document",
    r"^How to provide feedback",
    r"^Summary of changes",
    r"^Tables\.*\s*\d*$",
)
#: Chapter number and the prefix of its codes.
CODE_CHAPTERS = {2: "ABEND_", 3: "WAIT_", 6: "SADUMP_WAIT_", 7: "IPCS_"}
#: Headings that open the part shared by all sub-codes.
SHARED_HEADINGS = ("System action", "System programmer response", "Programmer response", "Operator response", "Source")


def _any(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _lines(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    out = files.select(F.col(id_col).alias("file"), F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "raw"))
    return out.withColumn("line", F.regexp_replace(F.regexp_replace("raw", r"\s+$", ""), "\f", ""))


def _joined(items: Column) -> Column:
    """Lines in order, without blank ones at the end."""
    text = F.array_join(F.transform(F.array_sort(items), lambda x: x["line"]), "\n")
    return F.regexp_replace(text, r"(?:\n[ \t\f]*)+$", "")


def message_entries(files: DataFrame, id_col: str = "filename", text_col: str = "content") -> DataFrame:
    """(file, block, msgid, text) of message manuals.

    Front matter, contents lines and page furniture go.  An entry starts at a line that is an
    id, or at an id with three or more words after it, unless it is the id of the entry at hand.
    """
    order = Window.partitionBy("file").orderBy("line_no")
    lines = _lines(files, id_col, text_col)
    starts = F.col("line").rlike(STANDALONE_ID) | F.col("line").rlike(INLINE_ID) | (F.col("line").startswith("Chapter") & F.col("line").contains("messages") & ~F.col("line").contains("..."))
    lines = lines.withColumn("body", F.max(starts.cast("int")).over(order)).where("body = 1")
    lines = lines.where(~F.col("line").contains("...") & ~F.col("line").rlike(_any(MESSAGE_NOISE)))
    alone, inline = F.regexp_extract("line", STANDALONE_ID, 1), F.regexp_extract("line", INLINE_ID, 1)
    rest = F.regexp_extract("line", INLINE_ID, 2)
    words = F.size(F.split(tx.trim(rest), r"\s+"))
    lines = lines.withColumns({"alone": alone, "rest": rest})
    lines = lines.withColumn("cand", F.when(F.col("alone") != "", F.col("alone")).when((inline != "") & (words >= 3), inline))
    # A candidate that is not accepted repeats the entry's id, so the last candidate is always the entry's id.
    before = F.last("cand", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("cand").isNotNull() & ((F.col("alone") != "") | before.isNull() | (before != F.col("cand")))
    lines = lines.withColumn("new", new).withColumn("block", F.sum(F.col("new").cast("int")).over(order)).where("block > 0")
    content = F.when(F.col("new") & (F.col("alone") != ""), F.lit(None)).when(F.col("new"), F.col("rest")).otherwise(F.col("line"))
    out = lines.withColumn("line", content).groupBy("file", "block").agg(
        F.max(F.when(F.col("new"), F.col("cand"))).alias("msgid"),
        _joined(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("line_no", "line")))).alias("text"),
    )
    return out.where(F.trim("text") != "")


def split_subcodes(code: str, text: str) -> list[tuple[str, str]]:
    """A wildcard entry as itself and one entry for each sub-code, with the shared head and foot."""
    lines = text.split("\n")
    marks = [i for i, x in enumerate(lines) if re.fullmatch(r"0C[0-9A-F]", x.strip())]
    if not marks:
        return [(code, text)]
    foot = next(
        (i for i in range(marks[0] + 1, len(lines)) if lines[i].strip() in SHARED_HEADINGS or (lines[i].strip().startswith("System action") and i - 1 in marks)),
        len(lines),
    )
    marks = [i for i in marks if i < foot]
    head, tail = "\n".join(lines[: marks[0]]).strip(), "\n".join(lines[foot:]).strip()
    out = [(code, text)]
    for a, b in zip(marks, [*marks[1:], foot]):
        own, body = lines[a].strip(), "\n".join(lines[a + 1 : b]).strip()
        if body:
            out.append((f"ABEND_{own}", "\n\n".join(x for x in (f"System abend code {own} (S{own})", head, body, tail) if x)))
    return out


def code_entries(files: DataFrame, id_col: str = "filename", text_col: str = "content") -> DataFrame:
    """(file, block, code, text) of the system-code manual.

    The chapter gives a code's prefix.  A code line counts only if the next line that is
    neither blank nor page furniture starts with 'Explanation'.  A chapter line other than the
    first chapter's closes the entry at hand.
    """
    order = Window.partitionBy("file").orderBy("line_no")
    after = order.rowsBetween(1, Window.unboundedFollowing)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    noise = _any(CODE_NOISE)
    lines = _lines(files, id_col, text_col)
    bare = F.regexp_replace("raw", r"^\s+|\s+$", "")
    lines = lines.withColumn("sense", F.when((bare != "") & ~bare.rlike(noise), bare))
    lines = lines.withColumn("next", F.first("sense", ignorenulls=True).over(after))
    chapter = F.regexp_extract("line", r"^Chapter (\d+)\.\s+", 1)
    lines = lines.withColumn("mark", F.when(chapter != "", chapter.cast("int")))
    lines = lines.withColumns({"chapter": F.last("mark", ignorenulls=True).over(so_far), "open": F.max((F.col("mark") == 2).cast("int")).over(so_far)})
    lines = lines.where(F.coalesce("open", F.lit(0)) == 1)
    hex_ = F.regexp_extract("line", r"^([0-9A-F]{3}|[0-9A-F]{2}[xX])$", 1)
    ipcs = F.regexp_extract("line", r"^(\d{4})$", 1)
    code = F.when(F.col("chapter").isin(2, 3, 6), hex_).when(F.col("chapter") == 7, ipcs).otherwise("")
    text_line = F.col("mark").isNull() & F.col("chapter").isin(*CODE_CHAPTERS) & ~F.col("line").rlike(noise) & ~F.col("line").contains("...")
    lines = lines.withColumn("code", F.when(text_line & (code != "") & F.coalesce(F.col("next").startswith("Explanation"), F.lit(False)), code))
    event = F.when(F.col("code").isNotNull(), "code").when(F.col("mark").isNotNull() & (F.col("mark") != 2), "close")
    lines = lines.withColumns({"block": F.sum(F.col("code").isNotNull().cast("int")).over(so_far), "state": F.last(event, ignorenulls=True).over(so_far), "text_line": text_line})
    lines = lines.where("state = 'code' AND text_line")
    prefix = F.create_map(*[x for k, v in CODE_CHAPTERS.items() for x in (F.lit(k), F.lit(v))])[F.col("chapter")]
    title = F.when(F.col("chapter") == 7, F.concat(F.lit("IPCS user completion code "), "code")).otherwise(F.concat(F.lit("System code "), "code", F.lit(" (S"), "code", F.lit(")")))
    lines = lines.withColumn("line", F.when(F.col("code").isNotNull(), title).otherwise(F.col("line")))
    out = lines.groupBy("file", "block").agg(F.max(F.concat(prefix, "code")).alias("code"), _joined(F.collect_list(F.struct("line_no", "line"))).alias("text"))

    @F.pandas_udf("array<struct<code:string,text:string>>")
    def split(codes: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([[{"code": c, "text": t} for c, t in split_subcodes(a, b)] for a, b in zip(codes, texts)])

    wild = out.where(F.col("code") == "ABEND_0Cx").withColumn("e", F.explode(split("code", "text"))).select("file", "block", "e.code", "e.text")
    return out.where(F.col("code") != "ABEND_0Cx").unionByName(wild)


def code_counts(codes: DataFrame) -> DataFrame:
    """One row: how many abend, wait-state and IPCS codes."""
    n = lambda *p: F.coalesce(F.sum(F.when(F.col("code").rlike("^(?:" + "|".join(p) + ")"), 1)), F.lit(0)).cast("long")
    return codes.agg(n("ABEND_").alias("abend"), n("WAIT_", "SADUMP_").alias("wait"), n("IPCS_").alias("ipcs"))


def manual_text(entries: DataFrame, key: str) -> DataFrame:
    """One cleaned manual for each file: every entry's id line, its text and a blank line."""
    one = F.concat(F.col(key), F.lit("\n"), F.col("text"), F.lit("\n\n"))
    items = F.array_sort(F.collect_list(F.struct("block", F.col(key).alias("k"), one.alias("t"))))
    return entries.groupBy("file").agg(F.array_join(F.transform(items, lambda x: x["t"]), "").alias("content"))
