"""Document sources: recursive scans, explicit files, suffix lists."""

from __future__ import annotations

import re
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_GLOB = re.compile(r"([\\*?\[\]{}])")
FILES = "filename string, mtime long, content string"


def parse_suffixes(text: str) -> list[str]:
    """'txt,.md' to ['.txt', '.md']; empty items are dropped."""
    items = [x.strip() for x in text.split(",")]
    return [x if x.startswith(".") else "." + x for x in items if x]


def has_suffix(path: Column, suffixes: list[str]) -> Column:
    """Case-sensitive; an empty list admits everything."""
    return reduce(lambda a, b: a | b, [path.endswith(s) for s in suffixes], F.lit(not suffixes))


def _read(spark: SparkSession, paths: list[str], recursive: bool) -> DataFrame:
    """Non-empty files; emptiness is told by the length, so contents are read only where they are used."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(paths).where("length > 0")
    mtime = F.unix_micros(F.col("modificationTime").cast("timestamp"))
    return raw.select(F.regexp_replace("path", "^file:", "").alias("filename"), mtime.alias("mtime"), F.decode("content", "UTF-8").alias("content"))


def scan(spark: SparkSession, directory: str, suffixes: str = "") -> DataFrame:
    """filename, mtime, content of every non-empty regular file below the directory that has a suffix of the list."""
    return _read(spark, [directory], True).where(has_suffix(F.col("filename"), parse_suffixes(suffixes)))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The named files whatever their suffix; empty files are skipped, and absent ones with a warning."""
    found = [p for p in paths if _exists(spark, p)]
    for p in sorted(set(paths) - set(found)):
        warnings.warn(f"no such file: {p}", stacklevel=2)
    return _read(spark, [_GLOB.sub(r"\\\1", p) for p in found], False) if found else spark.createDataFrame([], FILES)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
