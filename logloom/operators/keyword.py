"""Structured keyword search and timelines over stored chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import HIDDEN_TYPE, META


@dataclass(frozen=True)
class KeywordQuery:
    """Empty fields do not restrict."""

    msgid: str = ""
    jobname: str = ""
    sysname: str = ""
    severity: str = ""
    text: str = ""
    source_type: str = ""
    julian_date: str = ""
    ts_after: str = ""
    ts_before: str = ""


def wildcard_to_like(pattern: str) -> str:
    """'*' and '?' as LIKE wildcards; a backslash stands for itself."""
    return pattern.replace("\\", "\\\\").replace("*", "%").replace("?", "_")


def has_msgid(msgid: Column, one: str) -> Column:
    """Whether the comma-separated list has the id, ignoring case."""
    return F.lower(F.concat(F.lit(","), msgid, F.lit(","))).contains(f",{one.lower()},")


def predicate(q: KeywordQuery) -> Column:
    """Conjunction of the query's fields; equality on source_type and julian_date prunes partitions."""
    c = F.col("source_type") != HIDDEN_TYPE
    if q.msgid:
        like = wildcard_to_like(q.msgid)
        c &= F.col("msgid").ilike(f"%{like}%") if "%" in like or "_" in like else has_msgid(F.col("msgid"), q.msgid)
    if q.jobname:
        c &= F.col("jobname").ilike(wildcard_to_like(q.jobname))
    if q.text:
        c &= F.col("snippet").ilike(f"%{wildcard_to_like(q.text)}%")
    for field in ("sysname", "severity", "source_type", "julian_date"):
        if getattr(q, field):
            c &= F.col(field) == getattr(q, field)
    if q.ts_after:
        c &= F.col("ts_end") >= q.ts_after
    if q.ts_before:
        c &= F.col("ts_start") <= q.ts_before
    return c



def latest_first() -> list[Column]:
    return [F.desc("julian_date"), F.desc("ts_start"), F.asc("rowid")]


def results(chunks: DataFrame, tag: str = "", distance: Column | None = None) -> DataFrame:
    """The result columns of chunks; the embedding is not read."""
    d = F.lit(0.0) if distance is None else distance
    return chunks.select(d.cast("float").alias("distance"), F.col("id").alias("rowid"), *META, F.lit(tag).alias("store_tag"))


def keyword_search(chunks: DataFrame, query: KeywordQuery, limit: int = 20, tag: str = "") -> DataFrame:
    """The latest matches; top-k without a full sort."""
    return results(chunks.where(predicate(query)), tag).orderBy(*latest_first()).limit(limit)


def timeline_bounds(ts: str, window: int = 10) -> tuple[str, str]:
    """First and last instant of the minutes around HH:MM, clamped to the day."""
    digits = ts[:2].isdigit() and ts[3:5].isdigit()
    minute = int(ts[:2]) * 60 + int(ts[3:5]) if len(ts) >= 5 and digits else 0
    lo, hi = max(0, minute - window), min(1439, minute + window)
    return f"{lo // 60:02d}:{lo % 60:02d}:00.00", f"{hi // 60:02d}:{hi % 60:02d}:59.99"


def timeline(chunks: DataFrame, julian_date: str, ts: str, window: int = 10, sysname: str = "") -> DataFrame:
    """All chunks of a day that overlap the window, earliest first."""
    lo, hi = timeline_bounds(ts, window)
    c = (F.col("source_type") != HIDDEN_TYPE) & (F.col("julian_date") == julian_date) & (F.col("ts_end") >= lo) & (F.col("ts_start") <= hi)
    if sysname:
        c &= F.col("sysname") == sysname
    return results(chunks.where(c)).orderBy("ts_start", "rowid")
