"""Connected components of an edge table by repeated contraction, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node of the component.

    edges: (a, b).  Each round sends every vertex to its smallest neighbour or itself, then
    contracts; the number of vertices with edges at least halves, so rounds grow with the
    logarithm of the largest component.  Each round's tables are written to the shared folder.
    """
    edges = written(edges.where("a != b").select("a", "b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to"))
        least = written(least, "least")
        old = labels, edges, least
        if labels is None:
            labels = least.toDF("node", "component")
        else:
            moved = labels.join(least, labels.component == least.u, "left")
            labels = moved.select("node", F.coalesce("to", "component").alias("component"))
        labels = written(labels, "labels")
        a = edges.join(least, edges.a == least.u).select(F.col("to").alias("a"), "b")
        ab = a.join(least, a.b == least.u).select("a", F.col("to").alias("b"))
        edges = written(ab.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        discard(*old)
    if labels is not None:
        discard(edges)
    if labels is None:
        return edges.toDF("node", "component")
    return labels
