"""Small helpers over DataFrames that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_PATH = "_written_at"


def unused(columns: list[str], name: str) -> str:
    """The name, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str, spread: str | None = None) -> DataFrame:
    """A Parquet table.  spread: an id by which it is dealt out over the cores if its files have fewer splits than these.

    Only small files have so few splits, so nothing large is shuffled; sorted, a task that is run
    again finds its rows in the same order.
    """
    out = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and out._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        out = out.repartition(cores, spread).sortWithinPartitions(spread)
    return out


def fold(column: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty string."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % parts


def n_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shards_for(texts: DataFrame, text_col: str, shard_bytes: int) -> int:
    """The shuffle partitions, or one shard for every shard_bytes of text if that is more."""
    size = texts.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return max(n_partitions(texts.sparkSession), -(-size // shard_bytes))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, a single-machine session gets a temporary folder and a cluster an error.
    """
    jsc = spark.sparkContext._jsc.sc()
    found = jsc.getCheckpointDir()
    if found.isDefined():
        return found.get()
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="logloom-checkpoint-")
    spark.sparkContext.setCheckpointDir(configured)
    return jsc.getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # Once the table is complete, nothing needs the shuffle files that led to it.
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__[_PATH] = path  # not as an attribute, which a column of that name would answer for
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``written`` made and nothing reads any more."""
    for t in tables:
        path = t.__dict__.get(_PATH) if t is not None else None
        if path:
            p = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
