"""Vector column functions (V1-V7) and vector text form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.functions.text import java_string_hash
from engram.schemas import EMBEDDING_DIM

VECTOR = T.ArrayType(T.FloatType(), containsNull=False)


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def vector_norm(v: Column) -> Column:
    return F.sqrt(_dot(v, v))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; null for a zero vector."""
    return F.try_divide(_dot(a, b), vector_norm(a) * vector_norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def clamp_unit(similarity: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), similarity))


def mock_embedding(text: Column, dim: int = EMBEDDING_DIM) -> Column:
    """Deterministic stand-in for a model: half-shifted sines of the text hash."""
    def waves(start: Column) -> Column:
        angles = F.sequence(start, start + F.lit(dim - 1))
        return F.transform(angles, lambda x: (F.sin(x.cast("double")) * 0.5 + 0.5).cast("float"))

    # the outer one-element array names the hash, so it is computed once
    return F.transform(F.array(java_string_hash(text)), waves)[0]


def has_dimension(embedding: Column, dim: int = EMBEDDING_DIM) -> Column:
    return F.coalesce(F.size(embedding) == dim, F.lit(False))


def vector_to_text(embedding: Column) -> Column:
    return F.to_json(embedding)


def vector_from_text(text: Column) -> Column:
    return F.from_json(text, VECTOR)


def embed_with(
    df: DataFrame,
    embed_batch: Callable[[list[str]], np.ndarray],
    text_col: str = "text",
    out_col: str = "embedding",
    batch_size: int = 256,
    dim: int = EMBEDDING_DIM,
) -> DataFrame:
    """Embed ``text_col`` with a caller's batch function, order kept.

    Each distinct text is sent once. The function gets at most ``batch_size``
    texts per call and must return one row of ``dim`` numbers per text.
    """
    texts = df.select(text_col).where(F.col(text_col).isNotNull()).distinct()
    schema = T.StructType([T.StructField(text_col, T.StringType()), T.StructField(out_col, VECTOR)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf[text_col].iloc[start : start + batch_size].tolist()
                vectors = np.asarray(embed_batch(part), dtype=np.float32)
                if vectors.shape != (len(part), dim):
                    raise ValueError(f"embedder returned {vectors.shape}, wanted {(len(part), dim)}")
                yield pd.DataFrame({text_col: part, out_col: list(vectors)})

    return df.join(texts.mapInPandas(run, schema), text_col, "left")
