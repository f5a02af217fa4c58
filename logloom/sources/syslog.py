r"""Console logs to one row per logical message.

A record line is a type letter (N, M, X, C), flags, system, Julian date, time, job, a hex flag
word and the text; S, D and E lines continue the message before them.  Order comes from
(stream, line number), so any number of files is parsed in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx

LINE = r"(?s)\A[NMXC][ 0-9a-fA-Z]?+[0-9a-fA-Z]*+ *+([^ ]*+) *+([0-9]*+) *+(..:..:.{5})?+ *+([^ ]*+) *+[0-9a-fA-F]*+ *+(.*)\z"
CONTAINER = "data map<string,struct<content:string,content_length:long>>, system_logs int"
SPLIT_LINE = ("_metadata.file_path AS stream", "_metadata.file_block_start AS split", "value AS line")
MAX_STRING = (1 << 31) - 1
MIN_LINE = 10
PART = 1 << 20


def lines_of(files: DataFrame, content: str = "value", stream: Column | None = None) -> DataFrame:
    """Whole texts to (stream, line_no, line), empty texts giving none."""
    stream = F.lit("") if stream is None else stream
    out = files.select(stream.alias("stream"), F.posexplode(F.split(content, "\n", -1)).alias("line_no", "line"))
    return out.withColumn("line", F.regexp_replace("line", "\r$", ""))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Log files as lines; each file is a stream, read in splits however large it is.

    A line's number is its split's byte offset plus its place in the split.  As every line has
    a byte at least, numbers rise through the file and never repeat.
    """
    return numbered(spark.read.text(path).selectExpr(*SPLIT_LINE))


def numbered(lines: DataFrame) -> DataFrame:
    """Lines with their file and split (SPLIT_LINE), straight from a scan, to (stream, line_no, line)."""
    raw = lines.withColumn("row", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy("stream", "split").orderBy("row"))
    return raw.select("stream", (F.col("split") + place - 1).alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"))


def json_lines(documents: DataFrame, content: str = "value", within: Column | None = None) -> DataFrame:
    """Lines of collected logs wrapped in JSON: each system's content is a stream (of its document, if ``within`` names it).

    A content may be as long as a string can be; the parser's own limit would lose whole documents.
    """
    within = F.lit("") if within is None else F.concat(within, F.lit("#"))
    data = documents.select(within.alias("within"), F.explode(F.from_json(content, CONTAINER, {"maxStringLen": str(MAX_STRING)})["data"]).alias("system", "log"))
    return lines_of(data, "log.content", F.concat("within", "system"))


def bare(messages: DataFrame, text: str = "value") -> DataFrame:
    """Message texts without any log frame, such as one typed by hand."""
    msgid = tx.extract_msgid(F.col(text))
    empty = F.lit("")
    return messages.select(
        F.lit("").alias("stream"), F.monotonically_increasing_id().alias("seq"), empty.alias("sysname"), empty.alias("julian_date"),
        empty.alias("ts"), empty.alias("jobname"), F.col(text).alias("text"), msgid.alias("msgid"), tx.severity_of(msgid).alias("severity"),
    )


def parse(lines: DataFrame, severity_optional: bool = False) -> DataFrame:
    """(stream, line_no, line) to messages: stream, seq, sysname, julian_date, ts, jobname, text, msgid, severity.

    A continuation before any record, and any other line, is dropped.  Heads are found inside
    parts of ``PART`` line numbers; only one row a part takes the last head to the next parts,
    so a very long stream is not one task.
    """
    kind = F.substring("line", 1, 1)
    kept = lines.where(F.length("line") >= MIN_LINE).withColumn("head", kind.isin("N", "M", "X", "C"))
    kept = kept.where(F.col("head") | kind.isin("S", "D", "E"))
    kept = kept.withColumn("part", F.floor(F.col("line_no") / PART))
    heads = F.when(F.col("head"), F.col("line_no"))
    before = Window.partitionBy("stream").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = kept.groupBy("stream", "part").agg(F.max(heads).alias("last")).withColumn("carried", F.last("last", ignorenulls=True).over(before)).drop("last")
    inside = Window.partitionBy("stream", "part").orderBy("line_no")
    kept = kept.withColumn("no", F.last(heads, ignorenulls=True).over(inside)).join(carried, ["stream", "part"])
    kept = kept.withColumn("no", F.coalesce("no", "carried")).where("no IS NOT NULL")
    part = lambda n: F.regexp_extract("line", LINE, n)
    kept = kept.withColumn("body", F.when(F.col("head"), part(5)).otherwise(tx.trim(F.expr("substring(line, 2)"))))
    first = lambda n: F.max(F.when(F.col("head"), part(n)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "body"))), lambda x: x["body"]), " ")
    out = kept.groupBy("stream", "no").agg(
        F.min("line_no").alias("seq"), first(1).alias("sysname"), first(2).alias("julian_date"), first(3).alias("ts"), first(4).alias("jobname"),
        text.alias("text"), F.max(F.when(F.col("head"), F.col("body"))).alias("own"),
    )
    msgid = tx.extract_msgid(F.col("own"), severity_optional)
    return out.withColumn("msgid", msgid).select(
        "stream", "seq", "sysname", "julian_date", "ts", "jobname", "text", "msgid", tx.severity_of(F.col("msgid")).alias("severity")
    )


def since(messages: DataFrame, start: Column) -> DataFrame:
    """Messages at or after a timestamp; those without a valid time are dropped."""
    return messages.where(tx.event_time(F.col("julian_date"), F.col("ts")) >= start)
