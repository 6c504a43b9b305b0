"""Vector arithmetic on array columns, in double precision, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products, added in order."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def scale(a: Column, by: Column | float) -> Column:
    by = F.lit(by) if isinstance(by, float) else by
    return F.transform(doubles(a), lambda x: x * by)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def fold_query(q: Column, w_text: Column, w_difference: Column, w_product: Column, w_dot: float) -> Column:
    """The vector whose dot product with p ranks as a linear layer over [p, p - q, p * q, p . q, q] does."""
    return add(add(w_text, w_difference), add(multiply(q, w_product), scale(q, w_dot)))


def merged_score(p: Column, q: Column, w_text: Column, w_difference: Column, w_product: Column, w_dot: float) -> Column:
    """The linear layer itself, without the part that only the query has."""
    return dot(p, w_text) + dot(subtract(p, q), w_difference) + dot(multiply(p, q), w_product) + F.lit(w_dot) * dot(p, q)


def pool_max(vectors: Column, floor: float = -1e29) -> Column:
    """Largest value of each dimension over a list of vectors, at least ``floor``."""
    size = F.size(F.get(vectors, 0))
    return F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.greatest(F.lit(floor), F.array_max(F.transform(vectors, lambda v: F.get(v, i).cast("double")))),
    )


def reformulate(q: Column, paragraph: Column, alpha: float = 0.5) -> Column:
    """q + alpha * paragraph: a stand-in where no trained reformulation is at hand."""
    return add(q, scale(paragraph, alpha))
