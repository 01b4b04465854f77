"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import once


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; null if a vector is null, empty or zero, or the sizes differ."""
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot(a, b) / length)


def cosine_safe(a: Column, b: Column, epsilon: float = 1e-9) -> Column:
    """Cosine similarity with an epsilon in the denominator, so zero vectors give 0."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(epsilon))


def unit(v: Column) -> Column:
    """The vector divided by its length; zero vectors stay."""
    return once(norm(v), lambda length: F.transform(_doubles(v), lambda x: F.when(length > 0, x / length).otherwise(x)))


def masked_mean(tokens: Column, mask: Column, dim: int) -> Column:
    """Mean over the token vectors whose mask is 1; an empty mask divides by 1e-9."""
    kept = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1e-9))
    weighted = F.zip_with(tokens, mask, lambda t, m: F.transform(t, lambda x: x.cast("double") * m))
    zero = F.array_repeat(F.lit(0.0), dim)
    return F.transform(F.aggregate(weighted, zero, lambda s, t: F.zip_with(s, t, lambda x, y: x + y)), lambda x: x / kept)
