"""Embedding texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.kernels import hash_embedding
from ..providers import EmbeddingProvider


def hash_embed(text: Column, dim: int = 384) -> Column:
    """Feature-hashed vectors. Tokens come from the JVM; only hashing runs in Python, over Arrow batches."""

    @F.pandas_udf("array<float>")
    def of(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: hash_embedding(list(t), dim) if t is not None else np.zeros(dim, np.float32))

    return of(X.tokenize(text))


def embed(df: DataFrame, text: Column, provider: EmbeddingProvider | None, batch_size: int = 64, dim: int = 384) -> DataFrame:
    """``df`` with ``embedding``: hashed ones, or those of a provider called with up to ``batch_size`` texts at a time."""
    if provider is None:
        return df.withColumn("embedding", hash_embed(text, dim))

    @F.pandas_udf("array<float>")
    def of(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            vectors: list[list[float]] = []
            for at in range(0, len(texts), batch_size):
                some = texts.iloc[at : at + batch_size].tolist()
                got = provider.embed(some)
                if len(got) != len(some):
                    raise RuntimeError(f"the provider gave {len(got)} vectors for {len(some)} texts")
                vectors += got
            yield pd.Series([np.asarray(v, np.float32) for v in vectors], index=texts.index, dtype=object)

    return df.withColumn("embedding", of(text))
