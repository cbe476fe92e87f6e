"""Column expressions on ARRAY<FLOAT> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def as_double(v) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def dot(a, b) -> Column:
    prod = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a, b) -> Column:
    """dot / (|a| |b| + 1e-12)."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(EPS))


def is_finite(a) -> Column:
    bad = F.exists(
        as_double(a),
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))),
    )
    return ~bad


def unit(a) -> Column:
    """Vector scaled to unit norm."""
    n = norm(a)
    return F.transform(as_double(a), lambda x: x / n)


def vector_status(a, dim: int, rtol: float = 1e-4, atol: float = 1e-5) -> Column:
    """'ok' or the first reason why a vector is not a usable unit vector."""
    n = norm(a)
    tolerance = F.greatest(F.lit(rtol) * F.greatest(n, F.lit(1.0)), F.lit(atol))
    return (
        F.when(F.col(a).isNull() | (F.size(F.col(a)) != dim), "wrong_dim")
        .when(~is_finite(a), "non_finite")
        .when(n <= EPS, "zero_norm")
        .when(F.abs(n - 1.0) > tolerance, "not_unit")
        .otherwise("ok")
    )
