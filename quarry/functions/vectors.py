"""Vector expressions: sums run left to right in double, so results do not depend on the plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_distance_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, d: s + d * d)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """v divided by its norm; a zero vector stays."""
    scaled = lambda n: F.transform(v, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))
    return F.transform(F.array(norm(v)), scaled)[0]  # as a bound variable the norm is computed once, not for each element


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))
