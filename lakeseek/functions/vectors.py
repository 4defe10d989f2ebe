"""Vector expressions over array columns; there is no vector type, so they are higher-order functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, from left to right; vectors of different lengths raise."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.raise_error(F.lit("vectors have different lengths")).cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(v: Column) -> Column:
    """To length 1; the zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: (x.cast("double") / F.when(n == 0, 1.0).otherwise(n)).cast("float"))


def hash_embedding(text: Column, dims: int = 256) -> Column:
    """Deterministic stand-in for a model: the bytes of the text's SHA-256 over 255, repeated to `dims` numbers."""
    numbers = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(F.sha2(text, 256), i * 2 + 1, F.lit(2)), 16, 10).cast("double") / F.lit(255.0))
    return F.slice(F.flatten(F.array_repeat(numbers, (dims + 31) // 32)), 1, dims)


def hash_embed(text: str, dims: int = 256) -> list[float]:
    """The same numbers for one text, L2-normalised."""
    digest = hashlib.sha256(text.encode()).digest()
    raw = [digest[i % 32] / 255 for i in range(dims)]
    n = sum(x * x for x in raw) ** 0.5 or 1.0
    return [x / n for x in raw]
