"""The chunk store: Parquet snapshots partitioned by source type and day.

Appends add files to the current snapshot.  Rewrites (deleting or replacing files) write a new
snapshot and then publish it, so readers never see a half-written store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental
from ..schema import CHUNKS, conform

PARTITIONS = ("source_type", "julian_date")


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        return sorted(int(n.removeprefix("snapshot=")) for n in names if n.startswith("snapshot="))

    def _at(self, version: int) -> str:
        return f"{self.path}/snapshot={version}"

    def read(self) -> DataFrame:
        """Every chunk under the canonical schema; an absent store is empty.  Columns missing in old files read as defaults."""
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], CHUNKS)
        # A given schema keeps partition values as they were written: a date is text, not a number.
        return conform(self.spark.read.schema(CHUNKS).parquet(self._at(versions[-1])))

    def count(self) -> int:
        return self.read().count()

    def totals(self) -> dict[str, int]:
        """Chunks stored and the messages in them."""
        r = self.read().agg(F.count("*").alias("chunks"), F.coalesce(F.sum("msg_count"), F.lit(0)).alias("messages")).first()
        return r.asDict()

    def append(self, chunks: DataFrame) -> None:
        """Add chunks; ids continue after the largest one unless given."""
        versions = self._versions()
        if "id" not in chunks.columns:
            start = (self.read().agg(F.max("id")).first()[0] or 0) + 1
            chunks = chunks.withColumn("id", F.monotonically_increasing_id() + start)
        self._write(conform(chunks), self._at(versions[-1] if versions else 1), "append")

    def replace(self, chunks: DataFrame, bases: DataFrame | None = None) -> None:
        """Drop every chunk of the files in bases (column base) and add chunks, in one step."""
        versions = self._versions()
        kept = self.read()
        if bases is not None:
            kept = incremental.without_files(kept, bases)
        start = (self.read().agg(F.max("id")).first()[0] or 0) + 1
        if "id" not in chunks.columns:
            chunks = chunks.withColumn("id", F.monotonically_increasing_id() + start)
        version = (versions[-1] if versions else 0) + 1
        hidden = f"{self.path}/.snapshot-{version}"
        self._write(kept.unionByName(conform(chunks)), hidden, "overwrite")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs.rename(path(hidden), path(self._at(version)))
        for old in versions[:-1]:
            self._fs.delete(path(self._at(old)), True)

    def delete_files(self, bases: DataFrame) -> None:
        self.replace(self.spark.createDataFrame([], CHUNKS), bases)

    @staticmethod
    def _write(chunks: DataFrame, path: str, mode: str) -> None:
        ordered = chunks.repartition(*PARTITIONS, F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions(*PARTITIONS, "sysname", "ts_start")
        ordered.write.mode(mode).partitionBy(*PARTITIONS).parquet(path)
