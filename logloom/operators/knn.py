"""Exact nearest neighbours.

A single query is an expression over the vectors: filter, distance, top-k; the filter runs
before the distance, so a filtered search is exact.  Many queries are scored block by block
with numpy over Arrow batches: each task keeps its own k best for each query, and only those
are shuffled.  Queries ship with the task closure in blocks of at most ``block_queries``, and
a task holds distances for one tile of ``TILE`` pairs at a time, however many queries there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as vx

#: Pairs of a query and a vector whose distances a worker holds at once, and vectors of a tile.
TILE, TILE_ROWS = 1 << 20, 2048


def knn(vectors: DataFrame, query: Sequence[float], k: int = 5, id_col: str = "id", vector_col: str = "embedding", where: Column | None = None, metric: str = "l2", digits: int | None = None) -> DataFrame:
    """The k nearest rows with their distance, all columns but the vector.

    digits: decimals that the distance is rounded to before rows are ranked by it.
    """
    if where is not None:
        vectors = vectors.where(where)
    q = F.array(*[F.lit(float(np.float32(x))) for x in query])
    # Vectors of another length come last and go after the limit: Spark would push a filter on vectors
    # that are still to be computed below their computation, and compute all of them twice.
    distance = F.when(F.size(vector_col) == len(query), vx.distance(F.col(vector_col), q, metric))
    scored = vectors.withColumn("distance", distance if digits is None else F.round(distance, digits))
    return scored.drop(vector_col).orderBy(F.col("distance").asc_nulls_last(), id_col).limit(k).where("distance IS NOT NULL")


def vector_of(vectors: DataFrame, key: int, id_col: str = "id", vector_col: str = "embedding") -> list[float]:
    return list(vectors.where(F.col(id_col) == key).select(vector_col).first()[0])


def _blocks(queries: DataFrame, key: str, vector: str, size: int) -> Iterator[tuple[list, np.ndarray]]:
    n = queries.count()
    parts = max(1, -(-n // size))
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    for p in range(parts):
        rows = (queries if parts == 1 else queries.where(part == p)).select(key, vector).collect()
        if rows:
            yield [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)


def _pieces(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and vectors of the rows with ``dim`` values, a tile's rows at a time and fewer of long vectors."""
    size = max(1, min(TILE_ROWS, TILE // max(1, dim)))
    for b in batches:
        b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column(1)), dim), False))
        for start in range(0, b.num_rows, size):
            part = b.slice(start, size)
            yield part.column(0), np.asarray(part.column(1).flatten(), np.float64).reshape(part.num_rows, -1)


def _place(found: tuple[float, object]) -> tuple:
    """The order of (distance, id): not a number after all others, null ids after all others."""
    d, one = found
    return (d != d, d if d == d else 0.0, one is None, one)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "id", vector_col: str = "embedding", query_id: str = "qid", query_vector: str = "qvec", metric: str = "l2", block_queries: int = 4096) -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest of every query."""
    kinds = queries.schema[query_id].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString()
    schema = f"`{query_id}` {kinds[0]}, `{id_col}` {kinds[1]}, distance double"
    found = None
    for keys, q in _blocks(queries, query_id, query_vector, block_queries):

        def run(batches: Iterator[pa.RecordBatch], keys=keys, q=q) -> Iterator[pa.RecordBatch]:
            best: list[list[tuple[float, object]]] = [[] for _ in keys]
            norms = (q * q).sum(1)
            bound = np.full(len(keys), np.inf)  # what a k-th best so far lets through
            for ids, v in _pieces(batches, q.shape[1]):
                own = (v * v).sum(1)
                largest = own[np.isfinite(own)].max(initial=0)
                for start in range(0, len(keys), TILE // TILE_ROWS):
                    tile = slice(start, start + TILE // TILE_ROWS)
                    rough = q[tile] @ v.T
                    if metric == "l2":
                        rough *= -2
                        rough += norms[tile, None]
                        rough += own
                    else:
                        n = np.sqrt(norms[tile, None] * own)
                        np.divide(rough, n, out=rough, where=n > 0)
                        rough[~(n > 0)] = 0
                        np.subtract(1, rough, out=rough)
                    # The product screens; whatever may be among the k best is measured exactly.
                    limit = bound[tile].copy()
                    new = np.flatnonzero(limit == np.inf)
                    if len(new):
                        at = min(k, len(ids)) - 1
                        limit[new] = np.partition(rough[new], at, 1)[:, at]
                    limit += 1e-6 * (1 + norms[tile] + largest) if metric == "l2" else 1e-6
                    hits, at = np.nonzero(~(rough > limit[:, None]))  # not a number is let through and comes last
                    ends = np.flatnonzero(np.diff(hits, append=-1)) + 1
                    for first, end in zip([0, *ends], ends):
                        i, near = start + hits[first], at[first:end]
                        # Sums run from the first value to the last, as SQL's do.
                        if metric == "l2":
                            d = np.sqrt(np.cumsum((v[near] - q[i]) ** 2, 1)[:, -1])
                        else:
                            n = np.sqrt(norms[i]) * np.sqrt(own[near])
                            d = 1 - np.divide(np.cumsum(v[near] * q[i], 1)[:, -1], n, out=np.zeros(len(near)), where=n > 0)
                        best[i] = sorted([*best[i], *zip(d.tolist(), (ids[j].as_py() for j in near))], key=_place)[:k]
                        if len(best[i]) == k:
                            bound[i] = best[i][-1][0] ** (2 if metric == "l2" else 1)
            flat = [(key, one, d) for key, found in zip(keys, best) for d, one in found]
            if flat:
                yield pa.RecordBatch.from_pydict({query_id: [x[0] for x in flat], id_col: [x[1] for x in flat], "distance": [x[2] for x in flat]})

        part = vectors.select(id_col, vector_col).mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema + ", rank int")
    order = Window.partitionBy(query_id).orderBy(F.col("distance"), F.col(id_col).asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
