"""Functions of vectors, as columns: JVM-side higher-order functions, double precision.

Vectors are arrays of numbers. Two vectors of different length are compared over the shorter length, as zip-and-truncate
would; null in, null out; a null element counts as 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0).cast("double"), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def _zip(a: Column | str, b: Column | str, f) -> Column:
    a, b = _c(a), _c(b)
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: f(x.cast("double"), y.cast("double")))


def dot(a, b) -> Column:
    """Inner product, unclamped."""
    return _sum(_zip(a, b, lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine01(a, b, eps: float = 1e-6) -> Column:
    """Cosine with the product of norms at least ``eps``, clamped to [0, 1]."""
    c = dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def cosine(a, b) -> Column:
    """True cosine, unclamped; 0 when a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def squared_l2(a, b) -> Column:
    return _sum(_zip(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a, b) -> Column:
    return F.sqrt(squared_l2(a, b))


def scale(a, factor: Column) -> Column:
    """Every element times the factor, which is worked out once and not for each element."""
    a = _c(a)
    return F.zip_with(a, F.array_repeat(factor, F.size(a)), lambda x, f: x.cast("double") * f)


def normalise(a, eps: float = 0.0) -> Column:
    """Unit length. ``eps`` 0: a zero vector stays as it is; else the norm counts as ``eps`` at least."""
    n = norm(a)
    if eps:
        return scale(a, F.lit(1.0) / F.greatest(n, F.lit(eps)))
    return F.when(n > 0, scale(a, F.lit(1.0) / n)).otherwise(F.transform(_c(a), lambda x: x.cast("double")))


def score_of_distance(d) -> Column:
    """Distance to score: 1 - d, clamped to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - _c(d)))


def similarity(a, b, metric: str = "cosine") -> Column:
    """Larger is better, whatever the metric: cosine, inner_product or euclidean (negated distance)."""
    if metric == "cosine":
        return cosine(a, b)
    if metric == "inner_product":
        return dot(a, b)
    if metric == "euclidean":
        return -l2(a, b)
    raise ValueError(f"unknown metric {metric}")


def add(a, b) -> Column:
    return _zip(a, b, lambda x, y: x + y)


def subtract(a, b) -> Column:
    return _zip(a, b, lambda x, y: x - y)


def merge_centroid(c, e) -> Column:
    """(c + e) / 2, unit length: an exponential average, which depends on the order."""
    return normalise(_zip(c, e, lambda x, y: (x + y) / 2.0), 1e-6)


def running_mean(mean, n: Column, e) -> Column:
    """(mean * n + e) / (n + 1), unit length."""
    return normalise(_zip(mean, e, lambda x, y: (x * n + y) / (n + 1)))


def drifted(c, e, alpha: float = 0.1) -> Column:
    """Exponential drift: (1 - alpha) c + alpha e, unit length."""
    return normalise(_zip(c, e, lambda x, y: x * (1 - alpha) + y * alpha))


def checked(a, dim: int) -> Column:
    """The vector, or an error when its length isn't ``dim``."""
    a = _c(a)
    said = F.concat(F.lit(f"expected {dim} elements, got "), F.size(a).cast("string"))
    return F.when(F.size(a) == dim, a).otherwise(F.raise_error(said).cast("array<float>"))


def from_bytes(b, dim: int) -> Column:
    """Little-endian float32 bytes to a vector; null unless there are ``4 * dim`` of them."""
    @F.pandas_udf("array<float>")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda v: np.frombuffer(v, "<f4") if v is not None and len(v) == 4 * dim else None)

    return decode(_c(b))


def to_bytes(a) -> Column:
    @F.pandas_udf("binary")
    def encode(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return encode(_c(a))
