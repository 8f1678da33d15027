"""Scalar expressions: association transforms and vector similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWEST = -1e38
SHIFT = 1e-8
TINY = 1e-12


def softplus(x: Column) -> Column:
    """ln(1 + e^x), the identity above 20."""
    return F.when(x > 20, x).otherwise(F.log1p(F.exp(x)))


def finite_log(p: Column) -> Column:
    return F.when(p > 0, F.ln(p))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with norms of at least 1e-12, within -1 and 1."""
    raw = dot(a, b) / (F.greatest(norm(a), F.lit(TINY)) * F.greatest(norm(b), F.lit(TINY)))
    return F.greatest(F.least(raw, F.lit(1.0)), F.lit(-1.0))


