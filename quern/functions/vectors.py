"""Vector functions on arrays, in the JVM."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of numbers, added up in double precision."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def similarity(distance: Column) -> Column:
    """1 for the same vector, falling towards 0."""
    return 1 / (1 + distance)


def hash_embedder(dim: int = 64):
    """A deterministic embedder for tests and as the plug-in's shape: words hashed to signed dimensions, unit length."""

    def embed(text: str | None) -> list[float]:
        vector = np.zeros(dim)
        for word in (text or "").lower().split():
            digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
            vector[int.from_bytes(digest[:4], "big") % dim] += 1.0 if digest[4] % 2 else -1.0
        length = np.linalg.norm(vector)
        return (vector / length if length else vector).tolist()

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(embed)

    return run
