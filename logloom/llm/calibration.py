"""Small pieces that fitted operators share: a bounded labelled sample and a logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, parts: int, held: int, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[int, str, int]], dict[int, int]]:
    """At most per_class whole texts of each of the labels 0 and 1, and how many labelled documents each has.

    Only ids whose fold is not ``held`` count.  The sample is the first per_class ids in the
    order of a hash, so it does not depend on partitioning.  A document with both labels has
    label 1, and of several texts of one id the largest counts.  What reaches the driver is bounded by 2 * per_class documents.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(id_col, parts) != held))
    known = known.groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    known = known.join(docs.select(id_col), id_col, "left_semi")
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = [known.where(F.col("label") == c).orderBy(F.xxhash64(id_col), id_col).limit(per_class) for c in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))
    one = docs.select(id_col, text_col).join(chosen, id_col).groupBy(id_col).agg(F.max(text_col).alias("text"), F.max("label").alias("label"))
    return sorted((r[0], r[1] or "", r[2]) for r in one.collect()), totals


class Logistic:
    """Ridge-regularised logistic regression on a few standardised features, by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2):
        x = np.asarray(x, float)
        x = x.reshape(len(y), x.size // len(y) if len(y) else x.shape[1] if x.ndim == 2 else 1)
        y = np.asarray(y, float)
        w = np.ones(len(y)) if weight is None else np.asarray(weight, float)
        if not len(y):
            self.mean, self.scale, self.beta = np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1] + 1)
            return
        self.mean = x.mean(0)
        self.scale = np.where(x.std(0) > 0, x.std(0), 1.0)
        a = np.column_stack([np.ones(len(y)), (x - self.mean) / self.scale])
        beta = np.zeros(a.shape[1])
        penalty = ridge * w.sum() * np.diag([1e-6, *[1e-2] * (a.shape[1] - 1)])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
            h = (a * (w * p * (1 - p) + 1e-9)[:, None]).T @ a + penalty
            step = np.linalg.solve(h, a.T @ (w * (y - p)) - penalty @ beta)
            beta += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        self.beta = beta

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float).reshape(-1, len(self.mean))
        z = self.beta[0] + ((x - self.mean) / self.scale) @ self.beta[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
