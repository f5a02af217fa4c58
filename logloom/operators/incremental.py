"""Incremental indexing: which files are new, changed or gone, and per-system high-water marks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def indexed_files(chunks: DataFrame) -> DataFrame:
    """(base, mtime): every indexed file and the latest modification time stored for it."""
    return chunks.groupBy(tx.base_filename(F.col("filename")).alias("base")).agg(F.max("mtime").alias("mtime"))


def classify(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """files (filename, mtime, ...) with status 'new', 'updated' or 'unchanged'."""
    old = indexed.select(F.col("base").alias("filename"), F.col("mtime").alias("__old"))
    status = F.when(F.col("__old").isNull(), "new").when(F.col("__old") == F.col("mtime"), "unchanged").otherwise("updated")
    return files.join(old, "filename", "left").withColumn("status", status).drop("__old")


def removed(indexed: DataFrame, files: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """Indexed files below the roots (all, if none are named) that the scan did not see."""
    if roots:
        indexed = indexed.where(reduce(lambda a, b: a | b, [F.col("base").startswith(r) for r in roots]))
    return indexed.join(files.select(F.col("filename").alias("base")), "base", "left_anti")


def without_files(chunks: DataFrame, bases: DataFrame) -> DataFrame:
    """chunks less all chunks of the files in bases (column base)."""
    return chunks.withColumn("__base", tx.base_filename(F.col("filename"))).join(bases.select(F.col("base").alias("__base")), "__base", "left_anti").drop("__base")


def high_water(chunks: DataFrame) -> DataFrame:
    """(sysname, mark): the latest instant of each system's log chunks, as date and time of day.

    A chunk's messages may have arrived out of order, so its start counts as well as its end.
    """
    log = chunks.where(F.col("source_type") == "operlog")
    return log.groupBy("sysname").agg(F.max(_instant(F.greatest("ts_start", "ts_end"))).alias("mark"))


def beyond(chunks: DataFrame, marks: DataFrame) -> DataFrame:
    """Chunks that start after their system's mark; systems without one pass whole."""
    return _after(chunks, marks, _instant(F.col("ts_start")))


def unseen(messages: DataFrame, marks: DataFrame) -> DataFrame:
    """Messages after their system's mark; systems without one pass whole."""
    return _after(messages, marks, _instant(F.col("ts")))


def _instant(ts: Column) -> Column:
    return F.concat(tx.full_date(F.col("julian_date")), F.lit(" "), ts)


def _after(rows: DataFrame, marks: DataFrame, at: Column) -> DataFrame:
    m = marks.select(F.col("sysname").alias("__sys"), F.col("mark").alias("__mark"))
    return rows.join(m, F.col("sysname") == F.col("__sys"), "left").where(F.col("__mark").isNull() | (at > F.col("__mark"))).drop("__sys", "__mark")


def counters(classified: DataFrame, gone: DataFrame) -> DataFrame:
    """(status, files): how many files each status has."""
    return classified.select("status").unionByName(gone.select(F.lit("removed").alias("status"))).groupBy("status").agg(F.count("*").alias("files"))
