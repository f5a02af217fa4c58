"""JSON and text forms of results, run metrics, and the enrichment cache."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..schema import DISPLAY_CHARS

_RED, _YELLOW, _GREEN, _CYAN, _RESET = "\033[0;31m", "\033[0;33m", "\033[0;32m", "\033[0;36m", "\033[0m"
_OPTIONAL = ("msgid", "severity", "jobname", "sysname", "ts_start", "ts_end", "julian_date")


def _some(c: str) -> Column:
    """Text for JSON, null if it is empty or blank so that the field is left out."""
    return tx.one_line(F.nullif(F.trim(F.col(c)), F.lit("")))


def results_json(results: DataFrame) -> DataFrame:
    """One JSON object for each result; empty fields are left out."""
    fields = [F.col("distance"), *[tx.one_line(F.col(c)).alias(c) for c in ("filename", "snippet")], *[_some(c).alias(c) for c in _OPTIONAL]]
    fields += [F.when(F.col("msg_count") > 0, F.col("msg_count")).alias("msg_count"), _some("store_tag").alias("store")]
    return results.select("rank", F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("json"))


def query_json(query: str, mode: str, results: DataFrame) -> str:
    rows = [json.loads(r["json"]) for r in results_json(results).orderBy("rank").collect()]
    return json.dumps({"query": query, "mode": mode, "results": rows}, ensure_ascii=False, indent=2)


def enriched_json(unique: DataFrame, context: DataFrame) -> DataFrame:
    """One JSON object for each message with its context array."""
    item = F.struct(
        "rank", "distance", tx.one_line(F.col("source_type")).alias("source_type"), tx.one_line(F.col("filename")).alias("filename"),
        tx.one_line(F.col("snippet")).alias("snippet"), _some("chunk_msgid").alias("msgid"), _some("ts_start").alias("ts_start"), _some("store_tag").alias("store"),
    )
    found = context.groupBy("msgid").agg(F.array_sort(F.collect_list(item)).alias("context"))
    one = unique.join(found, "msgid", "left").withColumn("context", F.transform(F.coalesce("context", F.array()), lambda x: x.dropFields("rank")))
    fields = ["msgid", "severity", F.col("ts").alias("timestamp"), "jobname", F.col("sysname").alias("system"), "count", tx.one_line(F.col("text")).alias("message"), "context"]
    return one.select("seq", F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("json"))


def summary_json(total: int, interesting: int, groups: DataFrame) -> str:
    names = ["msgid", "severity", "tier", "count", "sample_text", "first_timestamp", "last_timestamp", "jobnames", "sysnames", "history_count", "history_days"]
    rows = [json.loads(r[0]) for r in groups.orderBy("msgid").select(F.to_json(F.struct(*names))).collect()]
    return json.dumps({"total_messages": total, "interesting_messages": interesting, "groups": rows}, ensure_ascii=False, indent=2)


def _colour(severity: str, on: bool) -> tuple[str, str]:
    code = {"A": _RED, "E": _RED, "W": _YELLOW, "I": _GREEN}.get(severity, "")
    return (code, _RESET if code else "") if on else ("", "")


def results_text(results: DataFrame, colour: bool = False) -> str:
    """Numbered results with a one-line head and the start of the snippet; for bounded top-k results."""
    out = []
    for r in results.orderBy("rank").collect():
        on, off = _colour(r["severity"], colour)
        head = [f"[{r['rank']}]" + (f" dist={r['distance']:.6g}" if r["distance"] > 0 else "") + (f" [{r['store_tag']}]" if r["store_tag"] else ""), r["filename"]]
        head += [f"msgid: {r['msgid']}"] if r["msgid"] else []
        head += [f"sev: {on}{r['severity']}{off}"] if r["severity"].strip() else []
        head += [f"job: {r['jobname']}"] if r["jobname"] else []
        head += [f"{r['ts_start']}-{r['ts_end']}"] if r["ts_start"] else []
        out.append(" | ".join(head) + "\n    " + r["snippet"][:DISPLAY_CHARS])
    return "\n\n".join(out)


def summary_text(total: int, interesting: int, tiered: DataFrame, colour: bool = False) -> str:
    """The tiers of a summary; tiered: groups with history and place (operators.console)."""
    shown = tiered.select(
        "tier", "place", "msgid", "severity", "count", tx.excerpt(F.col("sample_text"), F.col("msgid")).alias("excerpt"),
        tx.join_some(F.col("jobnames")).alias("jobs"), tx.join_some(F.col("sysnames")).alias("systems"), "history_count", "history_days",
    )
    rows = [r for r in shown.orderBy("tier", "place").collect()]
    ids = len(rows)
    out = ["=== Console Summary ===", f"Parsed {total} messages, {interesting} interesting, {ids} unique IDs", ""]
    for tier in ("critical", "warning"):
        mine = [r for r in rows if r["tier"] == tier]
        if not mine:
            continue
        on, off = _colour("E" if tier == "critical" else "W", colour)
        out.append(f"{on}{tier.upper()}:{off}")
        for r in mine:
            out.append(f"  {on}{r['msgid']}{off} x{r['count']}" + (f" -- {r['excerpt']}" if r["excerpt"] else ""))
            if r["jobs"]:
                out.append(f"    Jobs: {r['jobs']}  Systems: {r['systems']}")
            if r["history_count"] > 0:
                out.append(f"    Recurring: seen {r['history_count']} times across {r['history_days']} days in history")
            elif r["history_count"] == 0:
                out.append("    First occurrence in store history")
        out.append("")
    info = [r for r in rows if r["tier"] == "info"]
    if info:
        out.append(f"INFO ({len(info)} unique IDs, {sum(r['count'] for r in info)} total):")
        out.append("  " + ", ".join(f"{r['msgid']} x{r['count']}" for r in info[:8]) + (", ..." if len(info) > 8 else ""))
    return "\n".join(out)


class Metrics:
    """Named counts and wall-clock milliseconds of a run."""

    def __init__(self) -> None:
        self.values: dict[str, float] = {}

    def add(self, name: str, value: float) -> None:
        self.values[name] = self.values.get(name, 0) + value

    def timed(self, name: str):
        metrics = self

        class _Timer:
            def __enter__(self) -> None:
                self.began = time.perf_counter()

            def __exit__(self, *_: object) -> None:
                metrics.add(name, 1000 * (time.perf_counter() - self.began))

        return _Timer()

    def json(self) -> str:
        return json.dumps(self.values)


def write_manuals(manuals: DataFrame, path: str) -> None:
    """Cleaned manuals (file, content) as text files, a folder for each manual."""
    manuals.select("file", F.regexp_replace("content", r"\n\z", "").alias("content")).write.partitionBy("file").text(path)


CACHE = T.StructType([T.StructField(n, t) for n, t in (
    ("stamp", T.LongType()), ("key", T.StringType()), ("distance", T.FloatType()), ("source_type", T.StringType()), ("filename", T.StringType()),
    ("snippet", T.StringType()), ("store_tag", T.StringType()), ("ts_start", T.StringType()), ("msgid", T.StringType()))])


def load_cache(spark, path: str, ttl_seconds: int = 120, now: int | None = None) -> DataFrame:
    """Cached context rows no older than ttl_seconds."""
    now = int(time.time()) if now is None else now
    rows = spark.read.schema(CACHE).parquet(path)
    return rows.where(F.col("stamp") >= now - ttl_seconds)


def save_cache(context: DataFrame, path: str, key: str, now: int | None = None) -> None:
    """Append enriched context; key holds every option that shaped it, besides the message id."""
    now = int(time.time()) if now is None else now
    rows = context.select(
        F.lit(now).cast("long").alias("stamp"), F.concat_ws("|", F.lit(key), "msgid").alias("key"), F.col("distance").cast("float").alias("distance"),
        "source_type", "filename", "snippet", "store_tag", "ts_start", F.col("chunk_msgid").alias("msgid"),
    )
    rows.write.mode("append").parquet(path)
