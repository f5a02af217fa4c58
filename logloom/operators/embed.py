"""Embedders: anything with ``dim`` and ``encode(list of texts) -> float32 matrix``.

Models are out of scope here; the hashing embedder is a deterministic stand-in that needs
none, and precomputed vectors bypass embedding altogether.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DOCUMENT_PREFIX, QUERY_PREFIX = "search_document: ", "search_query: "
#: Tokens of context: a chunk's own and these for documents, console chunks, queries.
EXTRA_CONTEXT, CONSOLE_CONTEXT, QUERY_CONTEXT = 16, 512, 2048
#: Texts whose words are hashed and counted at once.
TEXTS = 512


@lru_cache(1 << 16)
def _word_hash(word: str) -> int:
    """The first 32 bits of the word's MD5."""
    return int.from_bytes(hashlib.md5(word.encode(), usedforsecurity=False).digest()[:4], "big")


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Signed feature hashing of lower-cased words, square-root counts, unit length; truncates to n_ctx words."""

    _word = re.compile(r"\w+")

    def __init__(self, dim: int = 64, n_ctx: int = QUERY_CONTEXT, prefix: str = ""):
        self.dim, self.n_ctx, self.prefix = dim, n_ctx, prefix

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for start in range(0, len(texts), TEXTS):
            hashes, sizes = [], []
            for text in texts[start : start + TEXTS]:
                words = self._word.findall((self.prefix + (text or "")).lower())[: self.n_ctx]
                hashes.extend(map(_word_hash, words))
                sizes.append(len(words))
            h = np.array(hashes, np.int64)
            at = np.repeat(np.arange(len(sizes)) * self.dim, sizes) + (h >> 1) % self.dim
            out[start : start + TEXTS] = np.bincount(at, (h & 1) * 2 - 1, len(sizes) * self.dim).reshape(-1, self.dim)
        out = np.sign(out) * np.sqrt(np.abs(out))
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)


class PooledEmbedder:
    """A token-level model as an embedder: tokenise, cut to n_ctx, run, pool, scale to unit length.

    tokenise: text -> token numbers; model: token numbers -> matrix with a row for each token (or
    a single row of a model that pools by itself); pooling: "mean" over the tokens or the "last".
    Both callables travel to the workers once, as part of the embedder.
    """

    def __init__(self, tokenise: Callable[[str], list[int]], model: Callable[[list[int]], np.ndarray], dim: int, pooling: str = "mean", n_ctx: int = QUERY_CONTEXT, prefix: str = ""):
        if pooling not in ("mean", "last"):
            raise ValueError(f"pooling {pooling!r}")
        self.tokenise, self.model, self.dim, self.pooling, self.n_ctx, self.prefix = tokenise, model, dim, pooling, n_ctx, prefix

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts):
            tokens = self.tokenise(self.prefix + (text or ""))[: self.n_ctx]
            if tokens:
                states = np.asarray(self.model(tokens), np.float32).reshape(-1, self.dim)
                row[:] = states.mean(0) if self.pooling == "mean" else states[-1]
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)


def embed(text: Column, embedder: Embedder) -> Column:
    """Unit vectors of a text column; the embedder is unpickled once for each worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            v = np.asarray(embedder.encode(s.fillna("").tolist()), np.float32)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.Series(list(np.divide(v, n, out=v.copy(), where=n > 0)), index=s.index, dtype=object)

    return run(text)
