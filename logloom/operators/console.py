"""Console messages: first occurrences, summaries, history and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import HIDDEN_TYPE, META, SAMPLE_CHARS
from .filters import DEFAULT, SkipList, interesting
from .fusion import RRF_K
from .knn import knn_batch

HISTORY_LIMIT = 200
INFO_SHOWN = 8


def first_by_msgid(messages: DataFrame) -> DataFrame:
    """The first message of each id and how often the id occurs."""
    cols = [c for c in messages.columns if c != "msgid"]
    out = messages.groupBy("msgid").agg(F.min_by(F.struct(*cols), "seq").alias("m"), F.count("*").alias("count"))
    return out.select("msgid", *[F.col(f"m.{c}").alias(c) for c in cols], "count")


def run_counters(messages: DataFrame, skip: SkipList = DEFAULT) -> DataFrame:
    """One row: messages parsed, skipped by the list, interesting, and their distinct ids."""
    msgid = F.col("msgid")
    kept = interesting(messages, skip).agg(F.count("*").alias("interesting"), F.count_distinct("msgid").alias("unique_ids"))
    seen = messages.agg(F.count("*").alias("parsed"), F.coalesce(F.sum(skip.skips(msgid).cast("long")), F.lit(0)).alias("skipped"))
    return seen.crossJoin(kept)  # one row by one row


def groups(messages: DataFrame) -> DataFrame:
    """A row for each message id: count, first and last timestamp in order of arrival, jobs, systems, sample, severity, tier."""
    some = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    out = messages.groupBy("msgid").agg(
        F.count("*").alias("count"), F.min_by("ts", "seq").alias("first_timestamp"), F.max_by("ts", "seq").alias("last_timestamp"),
        some("jobname").alias("jobnames"), some("sysname").alias("sysnames"),
        F.substring(F.min_by("text", "seq"), 1, SAMPLE_CHARS).alias("sample_text"), F.min_by("severity", "seq").alias("severity"),
    )
    return out.withColumn("tier", tx.tier(F.col("severity")))


def occurrences(chunks: DataFrame) -> DataFrame:
    """One row for each (chunk, message id of its list)."""
    return chunks.withColumn("one", F.explode(F.array_distinct(F.split(F.upper("msgid"), ",")))).where("one != ''")


def with_history(grouped: DataFrame, chunks: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """history_count and history_days of critical and warning groups among their latest log chunks; -1 and 0 elsewhere.

    An empty store annotates nothing.  The ids are pre-filtered by a semi join, so only chunks
    with an id in question reach the window.
    """
    asked = grouped.where(F.col("severity").isin("A", "E", "W")).select(F.upper("msgid").alias("one"))
    seen = occurrences(chunks.where(F.col("source_type") == "operlog").select("id", "msgid", "julian_date", "ts_start")).join(asked, "one", "left_semi")
    latest = Window.partitionBy("one").orderBy(F.desc("julian_date"), F.desc("ts_start"), "id")
    seen = seen.withColumn("n", F.row_number().over(latest)).where(F.col("n") <= limit)
    history = seen.groupBy("one").agg(F.count("*").alias("h"), F.count_distinct(F.nullif(F.col("julian_date"), F.lit(""))).alias("d"))
    any_ = chunks.limit(1).agg((F.count("*") > 0).alias("any"))
    out = grouped.join(history, F.upper("msgid") == F.col("one"), "left").crossJoin(F.broadcast(any_))
    told = F.col("any") & F.col("severity").isin("A", "E", "W")
    return out.withColumns({
        "history_count": F.when(told, F.coalesce("h", F.lit(0))).otherwise(-1).cast("long"),
        "history_days": F.when(told, F.coalesce("d", F.lit(0))).otherwise(0).cast("long"),
    }).drop("one", "h", "d", "any")


def by_tier(grouped: DataFrame, info_shown: int | None = INFO_SHOWN) -> DataFrame:
    """Groups with their place in their tier (most frequent first, then by id); info is cut to the shown ones."""
    place = Window.partitionBy("tier").orderBy(F.desc("count"), "msgid")
    out = grouped.withColumn("place", F.row_number().over(place))
    return out if info_shown is None else out.where((F.col("tier") != "info") | (F.col("place") <= info_shown))


def keyword_candidates(unique: DataFrame, chunks: DataFrame, k: int, store_rank: int, source_type: str = "") -> DataFrame:
    """The k latest chunks that list each message's id."""
    pool = chunks.where(F.col("source_type") != HIDDEN_TYPE)
    pool = pool.where(F.col("source_type") == source_type) if source_type else pool
    pool = occurrences(pool.select("id", "msgid", "julian_date", "ts_start"))
    hits = unique.select("msgid", F.upper("msgid").alias("one")).join(pool.withColumnRenamed("msgid", "__list"), "one")
    order = Window.partitionBy("msgid").orderBy(F.desc("julian_date"), F.desc("ts_start"), "id")
    hits = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return hits.select("msgid", F.lit(store_rank).alias("store"), F.col("id").alias("rowid"), "place", F.lit(0.0).alias("distance"))


def semantic_candidates(unique: DataFrame, chunks: DataFrame, k: int, store_rank: int, source_type: str = "") -> DataFrame:
    """The k chunks nearest to each message's vector (column qvec)."""
    pool = chunks.where(F.col("source_type") != HIDDEN_TYPE)
    pool = pool.where(F.col("source_type") == source_type) if source_type else pool
    near = knn_batch(pool, unique.select("msgid", "qvec"), k, query_id="msgid")
    return near.select("msgid", F.lit(store_rank).alias("store"), F.col("id").alias("rowid"), F.col("rank").alias("place"), "distance")


def enrich(unique: DataFrame, stores: list[tuple[str, DataFrame]], k: int = 5, source_type: str = "", rrf_k: int = RRF_K) -> DataFrame:
    """Context of every unique message (msgid, qvec): rows (msgid, rank, score, distance, store_tag, rowid, metadata).

    Keyword and semantic lists take k of each store, the first store's before the others'.
    Where both have hits they are fused and cut to k; else the one list stands uncut.  The
    source type restricts the first store only.
    """
    kw = sem = None
    for n, (_, chunks) in enumerate(stores):
        kind = source_type if n == 0 else ""
        a, b = keyword_candidates(unique, chunks, k, n, kind), semantic_candidates(unique, chunks, k, n, kind)
        kw, sem = (a, b) if kw is None else (kw.unionByName(a), sem.unionByName(b))
    order = Window.partitionBy("msgid").orderBy("store", "place")
    every = None
    for n, one in enumerate((kw, sem)):
        one = one.select("msgid", "store", "rowid", "distance", F.lit(n).alias("list"), F.row_number().over(order).alias("at"))
        every = one if every is None else every.unionByName(one)
    # One aggregation fuses the lists and tells, for each message, which of them have hits.
    fused = every.groupBy("msgid", "store", "rowid").agg(
        F.sum(1.0 / (rrf_k + F.col("at"))).alias("score"), F.min(F.struct("list", "at")).alias("first"), F.max("distance").alias("distance"),
        F.min("list").alias("lo"), F.max("list").alias("hi"),
    )
    mine = Window.partitionBy("msgid")
    place = F.row_number().over(mine.orderBy(F.round("score", 12).desc(), "first", "store", "rowid"))
    fused = fused.withColumns({"rank": place, "both": (F.min("lo").over(mine) == 0) & (F.max("hi").over(mine) == 1)})
    out = fused.where(~F.col("both") | (F.col("rank") <= k)).drop("both", "first", "lo", "hi")
    meta = None
    for n, (tag, chunks) in enumerate(stores):
        m = chunks.select(F.lit(n).alias("store"), F.col("id").alias("rowid"), F.lit(tag).alias("store_tag"), *[F.col(c).alias("chunk_msgid" if c == "msgid" else c) for c in META])
        meta = m if meta is None else meta.unionByName(m)
    return out.join(meta, ["store", "rowid"]).drop("store")
