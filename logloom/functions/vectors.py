"""Vector functions over ARRAY<FLOAT> columns.

The expression forms compose with any plan.  Bulk search uses operators/knn.py, which scores
Arrow batches with one matrix product each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double; 0 where a side is null or empty, or the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total).otherwise(F.lit(0.0))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit vector as floats; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: (x.cast("double") / n).cast("float"))).otherwise(v)


def l2_distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


def cosine_distance(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, F.lit(1.0) - dot(a, b) / n).otherwise(F.lit(1.0))


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    return l2_distance(a, b) if metric == "l2" else cosine_distance(a, b)


def decode_vector(blob: Column, byteorder: str = "little") -> Column:
    """float32 blob to ARRAY<FLOAT>; byteorder 'little' or 'big'."""
    kind = {"little": "<f4", "big": ">f4"}[byteorder]

    @F.pandas_udf("array<float>")
    def decode(blobs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in blobs:
            yield s.map(lambda b: None if b is None else np.frombuffer(b, kind).astype(np.float32))

    return decode(blob)


def encode_vector(vector: Column, byteorder: str = "little") -> Column:
    kind = {"little": "<f4", "big": ">f4"}[byteorder]

    @F.pandas_udf("binary")
    def encode(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in vectors:
            yield s.map(lambda v: None if v is None else np.asarray(v, kind).tobytes())

    return encode(vector)


def plausible(vector: Column) -> Column:
    """Whether the first four floats are finite and at most 2 in absolute value, as for a unit vector read in the right byte order."""
    return F.forall(F.slice(vector, 1, 4), lambda x: ~F.isnan(x) & (F.abs(x) <= 2.0))
