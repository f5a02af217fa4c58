"""Search over one or two chunk stores, as one lazy plan per mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import embed as em
from ..operators.fusion import fuse
from ..operators.keyword import keyword_search, latest_first
from ..operators.knn import knn
from ..schema import HIDDEN_TYPE, META
from .query import HYBRID, KEYWORD, SEMANTIC, Options, ParsedQuery, overlay, parse_query


def _ranked(df: DataFrame, store: int, order: list) -> DataFrame:
    """Position in a list of at most k rows; the single partition is bounded by k."""
    return df.withColumn("__store", F.lit(store)).withColumn("__place", F.row_number().over(Window.orderBy(*order)))


def _keyword(stores: list[tuple[str, DataFrame]], parsed: ParsedQuery, depth: list[int]) -> DataFrame:
    out = None
    for n, ((tag, chunks), k) in enumerate(zip(stores, depth)):
        one = _ranked(keyword_search(chunks, parsed.keyword, k, tag), n, latest_first())
        out = one if out is None else out.unionByName(one)
    return out


def _semantic(stores: list[tuple[str, DataFrame]], vector: list[float], depth: list[int], source_type: str, parsed: ParsedQuery, metric: str) -> DataFrame:
    """Nearest chunks of each store; type and time restrict the first store only."""
    out = None
    for n, ((tag, chunks), k) in enumerate(zip(stores, depth)):
        where = F.col("source_type") != HIDDEN_TYPE
        if n == 0:
            where &= F.col("source_type") == source_type if source_type else F.lit(True)
            where &= F.col("ts_end") >= parsed.keyword.ts_after if parsed.keyword.ts_after else F.lit(True)
            where &= F.col("ts_start") <= parsed.keyword.ts_before if parsed.keyword.ts_before else F.lit(True)
        near = knn(chunks.select("id", "embedding", *META), vector, k, where=where, metric=metric)
        near = near.select(F.col("distance").cast("float").alias("distance"), F.col("id").alias("rowid"), *META, F.lit(tag).alias("store_tag"))
        one = _ranked(near, n, ["distance", "rowid"])
        out = one if out is None else out.unionByName(one)
    return out


def search(query: str, chunks: DataFrame, knowledge: DataFrame | None = None, options: Options | None = None, embedder: em.Embedder | None = None, vector: list[float] | None = None, metric: str = "l2") -> DataFrame:
    """Result rows with rank (and score in hybrid mode), best first.

    Keyword mode neither embeds nor reads vectors.  Hybrid mode fuses 2k keyword and 2k
    semantic hits of the first store, followed by k of the knowledge store, into k results.
    """
    o = options or Options()
    parsed = overlay(parse_query(query), o)
    stores = [("", chunks)] + ([("ibm_doc", knowledge)] if knowledge is not None else [])
    if parsed.mode == KEYWORD:
        out = _keyword(stores, parsed, [o.k] * 2).orderBy("__store", "__place").limit(o.k)
        return _numbered(out, ["__store", "__place"])
    if vector is None:
        encoder = embedder or em.HashEmbedder(prefix=em.QUERY_PREFIX)
        text = parsed.text if parsed.mode == HYBRID and parsed.text else query
        vector = [float(x) for x in encoder.encode([text])[0]]
    if parsed.mode == SEMANTIC:
        out = _semantic(stores, vector, [o.k] * 2, o.source_type, parsed, metric).orderBy("distance", "__store", "rowid").limit(o.k)
        return _numbered(out, ["distance", "__store", "rowid"])
    depth = [2 * o.k, o.k]
    kw, sem = _keyword(stores, parsed, depth), _semantic(stores, vector, depth, o.source_type, parsed, metric)
    position = F.row_number().over(Window.orderBy("__store", "__place"))
    kw, sem = kw.withColumn("rank", position), sem.withColumn("rank", position)
    keys = ["store_tag", "rowid"]
    # One query: fuse's own order (score, then first list and place there) gives the ranks of at most 6k rows.
    best = fuse([x.withColumn("__q", F.lit(0)) for x in (kw, sem)], keys, k=o.k, by=["__q"]).drop("__q")
    every = sem.unionByName(kw).groupBy(*keys).agg(F.max("distance").alias("distance"), *[F.first(c).alias(c) for c in META])
    out = best.join(F.broadcast(every), keys)  # both sides hold at most 6k rows
    return out.orderBy("rank")


def _numbered(out: DataFrame, order: list) -> DataFrame:
    return out.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("__store", "__place").orderBy("rank")
