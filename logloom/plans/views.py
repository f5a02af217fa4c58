"""Console-shaped views over the driver's tables, and the same views as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, filters

_IDS = {"error": "IEF450E", "purchase": "IEC030A", "signup": "ICH408W", "click": "DFH1501I"}
_OTHER = "$HASP373I"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a console message."""
    e = table(spark, sf_dir, "events")
    msgid = None
    for kind, one in _IDS.items():
        msgid = F.when(F.col("event_type") == kind, one) if msgid is None else msgid.when(F.col("event_type") == kind, one)
    e = e.withColumn("msgid", msgid.otherwise(_OTHER))
    return e.select(
        F.lit("").alias("stream"), F.col("event_id").alias("seq"), F.concat(F.lit("SYS"), F.col("user_id") % 3).alias("sysname"),
        F.date_format("ts", "yyyyDDD").alias("julian_date"), F.date_format("ts", "HH:mm:ss.SS").alias("ts"),
        F.concat(F.lit("JOB"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("jobname"),
        F.concat("msgid", F.lit(" "), "props").alias("text"), "msgid", F.right("msgid", F.lit(1)).alias("severity"),
    )


def log_chunks(spark: SparkSession, sf_dir: str, minutes: int = 5, max_messages: int = 50, skip: bool = False) -> DataFrame:
    """The messages as stored window chunks; a chunk's id is its first message's number."""
    m = messages(spark, sf_dir)
    m = filters.drop_skipped(m) if skip else m
    return chunking.window_chunks(m, minutes, max_messages).withColumn("id", F.col("seq")).withColumn("mtime", F.lit(0).cast("long"))


MESSAGES_SQL = """
msg AS (
  SELECT event_id AS seq, 'SYS' || (user_id % 3) AS sysname, strftime(ts, '%Y%j') AS julian_date,
         substr(strftime(ts, '%H:%M:%S.%f'), 1, 11) AS ts, 'JOB' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS jobname,
         id || ' ' || props AS text, id AS msgid, right(id, 1) AS severity
  FROM (SELECT *, CASE event_type WHEN 'error' THEN 'IEF450E' WHEN 'purchase' THEN 'IEC030A' WHEN 'signup' THEN 'ICH408W'
                       WHEN 'click' THEN 'DFH1501I' ELSE '$HASP373I' END AS id FROM events))"""

SKIPPED_SQL = """(starts_with(msgid, '$HASP') OR msgid IN ('IEF196I', 'IEF695I', 'IEF285I', 'IEF237I', 'IGD103I', 'IGD104I',
  'IRR010I', 'ICH70001I', 'IEF188I', 'IEE042I', 'IEF176I'))"""

_RANK_SQL = "CASE severity WHEN 'A' THEN 7 WHEN 'E' THEN 6 WHEN 'W' THEN 5 WHEN 'S' THEN 4 WHEN 'D' THEN 3 WHEN 'X' THEN 2 WHEN 'I' THEN 1 ELSE 0 END"


def chunks_sql(minutes: int = 5, max_messages: int = 50, skip: bool = False) -> str:
    """CTEs up to ``chunk``; follow with a SELECT."""
    part = f"(row_number() OVER (PARTITION BY sysname, julian_date, run ORDER BY seq) - 1) // {max_messages}" if max_messages else "0"
    return f"""{MESSAGES_SQL},
kept AS (SELECT *, (CAST(substr(ts, 1, 2) AS INT) * 60 + CAST(substr(ts, 4, 2) AS INT)) // {minutes} AS w FROM msg
         WHERE {"NOT " + SKIPPED_SQL if skip else "true"}),
flag AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY sysname, julian_date ORDER BY seq) <> w, false) AS cut FROM kept),
runs AS (SELECT *, sum(CAST(cut AS INT)) OVER (PARTITION BY sysname, julian_date ORDER BY seq) AS run FROM flag),
parts AS (SELECT *, {part} AS part, {_RANK_SQL} AS rk FROM runs),
ids AS (SELECT sysname, julian_date, run, part, string_agg(msgid, ',' ORDER BY s) AS msgids
        FROM (SELECT sysname, julian_date, run, part, msgid, min(seq) AS s FROM parts GROUP BY ALL) GROUP BY ALL),
body AS (
  SELECT sysname, julian_date, run, part, min(seq) AS id, arg_min(jobname, seq) AS jobname, arg_min(ts, seq) AS ts_start,
         arg_max(ts, seq) AS ts_end, arg_max(severity, rk * 1000000000000 - seq) AS severity,
         string_agg(text, chr(10) ORDER BY seq) AS full_text, CAST(count(*) AS INT) AS msg_count
  FROM parts GROUP BY ALL),
chunk AS (
  SELECT id, 'operlog/' || sysname || '/' || julian_date || '/' || ts_start || '-' || ts_end AS filename, substr(full_text, 1, 500) AS snippet,
         'operlog' AS source_type, msgids AS msgid, severity, jobname, sysname, ts_start, ts_end, julian_date, msg_count, full_text
  FROM body JOIN ids USING (sysname, julian_date, run, part))"""
