"""Vector functions as column expressions; components are taken as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def normalise(v: Column) -> Column:
    """Unit length; zero vectors and those without a finite length stay as they are."""
    n = norm(v)
    return F.when((n > 0) & (n < float("inf")), F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def truncate(v: Column, dims: int) -> Column:
    """The first ``dims`` components at unit length; a shorter vector is an error."""
    kept = F.when(F.size(v) >= dims, F.slice(v, 1, dims)).otherwise(F.raise_error(F.lit(f"vector shorter than {dims}")).cast("array<double>"))
    return normalise(doubles(kept))
