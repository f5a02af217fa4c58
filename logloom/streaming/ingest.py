"""Continuous ingestion of console logs with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx
from ..operators import chunking, filters, incremental
from ..sources import syslog
from ..sources.store import ChunkStore


def log_files(spark: SparkSession, directory: str, max_files: int = 100) -> DataFrame:
    """New log files as lines with their file and split; a file of any size is read in splits."""
    raw = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(directory)
    return raw.selectExpr(*syslog.SPLIT_LINE)


def json_files(spark: SparkSession, directory: str, max_files: int = 100) -> DataFrame:
    """New files of collected logs wrapped in JSON, one document (value, stream) each."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files).load(directory)
    return raw.withColumn("stream", F.col("_metadata.file_path"))


def ingest(files: DataFrame, store: ChunkStore, checkpoint: str, minutes: int = chunking.WINDOW_MINUTES, max_messages: int = chunking.MAX_MESSAGES, skip: filters.SkipList = filters.DEFAULT, interval: str | None = None, embedder=None) -> StreamingQuery:
    """Each micro-batch: parse, drop skipped ids, cut what lies beyond the marks into window chunks, append them.

    files: of ``log_files`` or ``json_files``.  Count-bounded windows have no streaming aggregate, so
    every batch runs the batch operator.  A file comes only once, so its last window is stored as far
    as it goes; what a later file adds to that window is a chunk of its own.  A batch that is run
    again after a failure finds its messages below the marks.  With interval None the query takes
    all that is there and stops.
    """
    from ..operators.embed import embed

    def batch(df: DataFrame, _: int) -> None:
        lines = syslog.numbered(df) if "split" in df.columns else syslog.json_lines(df, within=F.col("stream"))
        messages = incremental.unseen(filters.drop_skipped(syslog.parse(lines), skip), incremental.high_water(store.read()))
        fresh = chunking.window_chunks(messages, minutes, max_messages, keys=("stream", "sysname", "julian_date"))
        if embedder is not None:
            fresh = fresh.withColumn("embedding", embed(F.col("full_text"), embedder))
        store.append(fresh.drop("seq"))

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)).start()


def severity_windows(messages: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Event-time counts of a stream of messages by system and severity, with a watermark for late lines."""
    stamped = messages.withColumn("event_ts", tx.event_time(F.col("julian_date"), F.col("ts"))).where("event_ts IS NOT NULL")
    counted = stamped.withWatermark("event_ts", late).groupBy(F.window("event_ts", f"{minutes} minutes").alias("w"), "sysname", "severity")
    return counted.agg(F.count("*").alias("messages")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "sysname", "severity", "messages")


def since(text: str, now_micros: int) -> int:
    """Whole minutes before now of YYYY-MM-DD, YYYY-MM-DDTHH:MM or YYYY-MM-DD HH:MM (UTC), at least 1; -1 if malformed."""
    from datetime import UTC, datetime

    for form in ("%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M", "%Y-%m-%d"):
        try:
            then = datetime.strptime(text, form).replace(tzinfo=UTC)
        except ValueError:
            continue
        return max(1, int((now_micros / 1e6 - then.timestamp()) // 60))
    return -1
