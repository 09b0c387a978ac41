"""Vector distances as column expressions; smaller is nearer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def inner(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine; 1 if either vector is zero."""
    norms = F.sqrt(inner(a, a)) * F.sqrt(inner(b, b))
    return F.when(norms == 0, F.lit(1.0)).otherwise(1 - inner(a, b) / F.when(norms == 0, F.lit(1.0)).otherwise(norms))


def dot(a: Column, b: Column) -> Column:
    """The negated inner product."""
    return -inner(a, b)


METRICS = {"l2": l2, "cosine": cosine, "dot": dot}
