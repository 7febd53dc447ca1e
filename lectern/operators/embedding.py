"""Embedding: a protocol, and a deterministic hashing embedder in two views."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Picklable; ``embed`` returns one row a text."""

    size: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


def unit_rows(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return (m / np.where(norm > 0, norm, 1)).astype(np.float32)


class HashingEmbedder:
    """Signed feature hashing of word unigrams and of character trigrams, each of unit length, concatenated.

    Scores of two texts lie between -2 and 2, as the sum of two cosines.
    """

    def __init__(self, half: int = 384):
        self.half, self.size = half, 2 * half

    def _view(self, texts: list[str], features) -> np.ndarray:
        out = np.zeros((len(texts), self.half))
        for row, t in zip(out, texts):
            h = np.fromiter((zlib.crc32(f.encode()) for f in features(t)), np.int64)
            np.add.at(row, (h >> 1) % self.half, 1 - 2 * (h & 1))
        return unit_rows(out)

    def embed(self, texts: list[str]) -> np.ndarray:
        low = [(t or "").lower() for t in texts]
        unigrams = self._view(low, lambda t: re.findall(r"\w+", t))
        trigrams = self._view(low, lambda t: (t[i : i + 3] for i in range(len(t) - 2)))
        return np.hstack([unigrams, trigrams])


def embedded(df: DataFrame, embedder: Embedder, text: str = "text", out: str = "embedding", batch: int = 256) -> DataFrame:
    """``df`` and its vectors, computed in Arrow batches."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            texts = s.fillna("").tolist()
            rows = [r for k in range(0, len(texts), batch) for r in embedder.embed(texts[k : k + batch]).tolist()]
            yield pd.Series(rows, dtype=object)

    return df.withColumn(out, F.pandas_udf(run, "array<float>")(F.col(text)))


def normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def concatenated(a: Column, b: Column) -> Column:
    """Two views as one vector, each of unit length: the inner product is the sum of the cosines."""
    return F.concat(normalised(a), normalised(b))
