"""Vectors of whole numbers, as clustering and hard-negative mining work on them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(dims: int) -> int:
    """Largest size of a component such that sums over dims of products of two of them stay under 2^55."""
    return math.isqrt((1 << 55) // max(dims, 1))


def finite(vector: str) -> Column:
    """True for vectors without null, NaN and infinite components; false for null."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def whole(vector: str, dims: int) -> Column:
    """floor(256 * x) of each component, held within +-bound(dims) (about 92,000 before scaling at 64 dims), so that no sum overflows."""
    most = F.lit(bound(dims))
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(F.lit(256.0) * x.cast("double")), most), -most).cast("int"))
