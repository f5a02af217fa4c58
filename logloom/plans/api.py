"""The pipelines a user runs: index documents, ingest logs, summarise, enrich, search once."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..operators import chunking, console, embed, filters, incremental
from ..schema import META
from ..sinks.render import Metrics
from ..sources import files as fs
from ..sources.store import ChunkStore
from .query import Options
from .search import search

_CARRIED = ["filename", "snippet", "source_type", "mtime", "msgid", "severity", "full_text"]


def document_rows(files: DataFrame, source_type: str = "document", chunk_tokens: int = chunking.CHUNK_TOKENS, overlap: int = chunking.OVERLAP_TOKENS) -> DataFrame:
    """Chunk rows of files (filename, mtime, content): one window keeps the file's name, several get ' [chunk N]'."""
    out = chunking.document_chunks(files, chunk_tokens=chunk_tokens, overlap=overlap)
    out = out.join(files.select("filename", "mtime"), "filename")
    many = F.col("n_tokens") > F.lit(chunking.token_budget(chunk_tokens, overlap)[0])
    name = F.when(many, F.concat("filename", F.lit(" [chunk "), "chunk_no", F.lit("]"))).otherwise(F.col("filename"))
    empty = F.lit("")
    return out.withColumns({"filename": name, "source_type": F.lit(source_type), "msgid": empty, "severity": empty}).select(*_CARRIED)


def manual_rows(files: DataFrame) -> DataFrame:
    """Chunk rows of message manuals: one for each entry."""
    out = chunking.manual_entries(files).join(files.select(F.col("filename").alias("base"), "mtime"), "base")
    return out.select(*_CARRIED)


def with_vectors(rows: DataFrame, embedder: embed.Embedder) -> DataFrame:
    return rows.withColumn("embedding", embed.embed(F.col("full_text"), embedder))


def index(spark: SparkSession, store: ChunkStore, directory: str, suffixes: str = "", manuals: bool = False, source_type: str = "document", embedder: embed.Embedder | None = None, chunk_tokens: int = chunking.CHUNK_TOKENS, overlap: int = chunking.OVERLAP_TOKENS, metrics: Metrics | None = None) -> dict[str, int]:
    """Bring the store up to date with the files below a directory; counts of files by status, also in metrics.

    Unchanged files are not read again; chunks of changed and vanished files below the
    directory are dropped and new ones added in one snapshot.  Other directories and logs stay.
    """
    began, metrics = time.perf_counter(), Metrics() if metrics is None else metrics
    found = fs.scan(spark, directory, suffixes)
    old = incremental.indexed_files(store.read().where("source_type NOT IN ('operlog', 'operlog_meta')"))
    status = incremental.classify(found.select("filename", "mtime"), old)
    gone = incremental.removed(old, found, [directory])
    stale = status.where("status = 'updated'").select(F.col("filename").alias("base")).unionByName(gone.select("base"))
    counts = {r["status"]: r["files"] for r in incremental.counters(status, gone).collect()}
    if set(counts) - {"unchanged"}:
        # The driver holds the listing of the directory anyway; only these files' contents are read.
        changed = [r["filename"] for r in status.where("status != 'unchanged'").select("filename").collect()]
        fresh = fs.read_files(spark, changed)
        rows = manual_rows(fresh) if manuals else document_rows(fresh, source_type, chunk_tokens, overlap)
        store.replace(with_vectors(rows, embedder or embed.HashEmbedder(n_ctx=chunk_tokens + embed.EXTRA_CONTEXT, prefix=embed.DOCUMENT_PREFIX)), stale)
    for name, n in counts.items():
        metrics.add(f"files_{name}", n)
    metrics.add("index_ms", 1000 * (time.perf_counter() - began))
    return counts


def ingest(messages: DataFrame, store: ChunkStore, minutes: int = chunking.WINDOW_MINUTES, max_messages: int = chunking.MAX_MESSAGES, skip: filters.SkipList = filters.DEFAULT, embedder: embed.Embedder | None = None, complete: bool = False, metrics: Metrics | None = None, part: int = 0) -> None:
    """Append the window chunks of the messages beyond each system's mark.

    A system's last window may still grow, so it is left for the next run, with all of its messages;
    with ``complete`` the log has ended and it is stored too.  metrics gets the chunks and messages stored;
    ``part`` splits very long days (chunking.window_chunks).
    """
    began = time.perf_counter()
    before = store.totals() if metrics is not None else {}
    fresh = incremental.unseen(messages, incremental.high_water(store.read()))
    fresh = filters.drop_skipped(fresh if complete else chunking.closed(fresh, minutes), skip)
    chunks = chunking.window_chunks(fresh, minutes, max_messages, part=part).drop("seq")
    store.append(with_vectors(chunks, embedder or embed.HashEmbedder(n_ctx=embed.CONSOLE_CONTEXT, prefix=embed.DOCUMENT_PREFIX)))
    if metrics is not None:
        for name, n in store.totals().items():
            metrics.add(name, n - before[name])
        metrics.add("ingest_ms", 1000 * (time.perf_counter() - began))


def summarize(messages: DataFrame, history: DataFrame | None = None, skip: filters.SkipList = filters.DEFAULT, verbose: bool = False) -> DataFrame:
    """Groups of interesting messages with tier, place in the tier and history; neither embeds nor reads vectors."""
    grouped = console.groups(filters.interesting(messages, skip, verbose))
    if history is None:
        grouped = grouped.withColumns({"history_count": F.lit(-1).cast("long"), "history_days": F.lit(0).cast("long")})
    else:
        grouped = console.with_history(grouped, history)
    return console.by_tier(grouped, None)


def enrich(messages: DataFrame, chunks: DataFrame, knowledge: DataFrame | None = None, k: int = 5, source_type: str = "", skip: filters.SkipList = filters.DEFAULT, verbose: bool = False, embedder: embed.Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """(unique interesting messages with counts, their context rows)."""
    unique = console.first_by_msgid(filters.interesting(messages, skip, verbose))
    encoder = embedder or embed.HashEmbedder(prefix=embed.QUERY_PREFIX)
    asked = unique.select("msgid", embed.embed(F.concat_ws(" ", "msgid", "text"), encoder).alias("qvec"))
    stores = [("", chunks)] + ([("ibm_doc", knowledge)] if knowledge is not None else [])
    return unique, console.enrich(asked, stores, k, source_type)


def search_once(spark: SparkSession, directory: str, query: str, suffixes: str = "", k: int = 5, embedder: embed.Embedder | None = None) -> DataFrame:
    """Index a directory in memory and search it semantically."""
    encoder = embedder or embed.HashEmbedder()
    rows = with_vectors(document_rows(fs.scan(spark, directory, suffixes)), encoder)
    rows = rows.withColumn("id", F.xxhash64("filename"))
    rows = rows.withColumns({c: F.lit(0) if c == "msg_count" else F.lit("") for c in META if c not in rows.columns})
    return search(query, rows, options=Options(mode="semantic", k=k), embedder=encoder)


def convert_vectors(chunks: DataFrame, blob: str = "embedding") -> DataFrame:
    """Vectors of a binary float32 column as ARRAY<FLOAT>, each in the byte order that brings its norm nearer to 1."""
    native, foreign = vx.decode_vector(F.col(blob), "little"), vx.decode_vector(F.col(blob), "big")
    out = chunks.withColumns({"__n": native, "__f": foreign})
    off = lambda c: F.abs(vx.norm(F.col(c)) - 1)  # noqa: E731  not-a-number counts as the largest
    return out.withColumn(blob, F.when(off("__n") <= off("__f"), F.col("__n")).otherwise(F.col("__f"))).drop("__n", "__f")
