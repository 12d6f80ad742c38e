"""Vector expressions over ARRAY columns; everything is computed in double precision inside the JVM.

A null vector, or vectors of different length, give null. A zero vector keeps its zeros when normalised and has cosine
distance 1 to everything.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row: inside a lambda a plain expression is computed per element."""
    return F.transform(F.array(value), body)[0]


def l2_normalize(a: Column) -> Column:
    n = norm(a)
    return bind(F.when(n == 0, 1.0).otherwise(n), lambda n: F.transform(a, lambda x: x.cast("double") / n))


def euclidean(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.sqrt(_sum(F.transform(d, lambda x: x * x))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, in [0, 2]; 1 if either vector is zero."""
    return 1.0 - dot(a, b) / (F.greatest(norm(a), F.lit(EPS)) * F.greatest(norm(b), F.lit(EPS)))


def is_usable(a: Column, dim: int) -> Column:
    """``dim`` finite values, not all zero."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(a) == dim) & finite & F.exists(a, lambda x: x != 0), F.lit(False))


def mean_vector(c: Column, dim: int) -> Column:
    """Aggregate: the arithmetic mean vector, null over no rows; partial sums are combined map-side in the JVM."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    # a zero row of weight 0 for null vectors, so that they do not count
    w = F.when(c.isNull(), 0.0).otherwise(1.0)
    v = F.coalesce(F.transform(c, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), dim))
    return F.when(F.sum(w) > 0, vector_to_array(Summarizer.mean(array_to_vector(v), w)))


def distance(kind: str, a: Column, b: Column) -> Column:
    if kind not in ("euclidean", "cosine"):
        raise ValueError(f"distance_type must be 'euclidean' or 'cosine', not {kind!r}")
    return euclidean(a, b) if kind == "euclidean" else cosine_distance(a, b)


def split_channels_normalized(parts: list[Column]) -> Column:
    """Channel vectors normalised one by one, then concatenated."""
    return reduce(lambda x, y: F.concat(x, y), [l2_normalize(p) for p in parts])
