"""Vector functions as Column expressions, and the deterministic stand-in embedding."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col

#: Embedding sizes by model; other models are an error.
MODEL_DIMS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072}


def dot(a: Column | str, b: Column | str) -> Column:
    """The inner product in double precision, summed from the first component on."""
    pairs = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """The cosine; null if either vector is zero or their lengths differ."""
    return F.when(F.size(col(a)) == F.size(col(b)), F.try_divide(dot(a, b), norm(a) * norm(b)))


def normalised(a: Column | str) -> Column:
    """The vector at length one; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(col(a), lambda x: (x.cast("double") / n).cast("float"))).otherwise(col(a).cast("array<float>"))


def model_dim(model: str) -> int:
    if model not in MODEL_DIMS:
        raise ValueError(f"no embedding size is known for {model!r}")
    return MODEL_DIMS[model]


def mock_embed(texts: list[str], dim: int) -> np.ndarray:
    """Unit vectors from a xorshift generator seeded by the SHA-256 of each text; all texts step together."""
    seed = np.array([int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little") or 1 for t in texts], np.uint64)
    out = np.empty((len(texts), dim), np.float32)
    for k in range(dim):
        seed ^= seed << np.uint64(13)
        seed ^= seed >> np.uint64(7)
        seed ^= seed << np.uint64(17)
        out[:, k] = (seed.astype(np.float64) / float(2**64 - 1) * 2 - 1).astype(np.float32)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=out, where=length > 0)


def mock_embedding(dim: int):
    """The stand-in embedding as an Arrow-batched function of a text column; null for null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        known = [t is not None and t == t for t in texts]
        made = iter(mock_embed([t for t, k in zip(texts, known, strict=True) if k], dim))
        return pd.Series([next(made) if k else None for k in known], dtype=object)

    return embed
