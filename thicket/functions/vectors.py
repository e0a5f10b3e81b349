"""A stand-in for an embedding model, for tests and for corpora without supplied vectors."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

#: Digest bytes of SHA-256: the vector has as many dimensions.
WIDTH = 32


def _digest(text: str) -> np.ndarray:
    return np.frombuffer(hashlib.sha256(text.encode()).digest(), np.uint8).astype("float64") / 127.5 - 1.0


def stand_in(text: str, tokens: list[str]) -> np.ndarray:
    """A unit vector from the hash of a text and, with less weight, those of its tokens."""
    v = _digest(text)
    for t in tokens:
        v = v + 0.3 * _digest(t)
    n = np.sqrt((v * v).sum())
    return (v / n if n else v).astype("float32")


def stand_in_vectors(text: Column, tokens: Column) -> Column:
    """``stand_in`` over Arrow batches."""

    @pandas_udf("array<float>")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([stand_in(x or "", list(y) if y is not None else []) for x, y in zip(a, b)])

    return f(text, tokens)
