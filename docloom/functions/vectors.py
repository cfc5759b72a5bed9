"""Vector similarity as column expressions, and a deterministic text embedder."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.tokens import query_tokens


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def cosine_to(a: Column, query: list[float]) -> Column:
    """Similarity to a question's vector, whose norm is known beforehand."""
    size = math.sqrt(sum(x * x for x in query))
    if not size:
        return F.lit(0.0)
    values = F.array(*[F.lit(float(x)) for x in query])
    n = norm(a)
    return F.when(n > 0, dot(a, values) / (n * size)).otherwise(0.0)


def embed_text(text: str | None, width: int = 384) -> list[float]:
    """Signed hashed tokens and 3-grams, of unit length; the offline stand-in for a sentence model."""
    import zlib

    out = np.zeros(width)
    for t in query_tokens(text or ""):
        for piece, w in [(t, 1.0), *((t[i : i + 3], 0.3) for i in range(len(t) - 2))]:
            h = zlib.crc32(piece.encode())
            out[h % width] += w if h >> 31 else -w
    n = float(np.linalg.norm(out))
    return (out / n if n else out).tolist()


def embed(text: Column, width: int = 384) -> Column:
    """embed_text() over Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: embed_text(t, width))

    return run(text)
