"""Reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def fuse(lists: list[DataFrame], keys: list[str], rank: str = "rank", k: int | None = None, rrf_k: int = RRF_K, by: list[str] | None = None) -> DataFrame:
    """Items of any list with score = sum of 1 / (rrf_k + rank), best first.

    by: query columns when many queries are fused at once; then k limits each of them.  Equal
    scores go by the first list an item is in, its rank there, and the keys.
    """
    by = by or []
    every = None
    for n, one in enumerate(lists):
        one = one.select(*by, *keys, F.lit(n).alias("__list"), F.col(rank).alias("__rank"))
        every = one if every is None else every.unionByName(one)
    out = every.groupBy(*by, *keys).agg(
        F.sum(1.0 / (rrf_k + F.col("__rank"))).alias("score"), F.min(F.struct("__list", "__rank")).alias("__first")
    )
    order = [F.round("score", 12).desc(), F.col("__first").asc(), *[F.col(c).asc() for c in keys]]
    if by:
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        out = out if k is None else out.where(F.col("rank") <= k)
        return out.drop("__first")
    out = out.orderBy(*order)
    return (out if k is None else out.limit(k)).drop("__first")
