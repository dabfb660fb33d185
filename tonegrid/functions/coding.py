"""The lossless coders' arithmetic as columns: residuals, Rice costs and parameter choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pcm import zigzag


def difference(x: Column, order: int = 1) -> Column:
    """The order-th finite difference of an array: that many elements shorter."""
    for _ in range(order):
        x = F.zip_with(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: a - b)
    return x


def restore(warm: Column, residual: Column) -> Column:
    """Undo difference() of order 1: running sums from the first value."""
    return F.transform(F.sequence(F.lit(0), F.size(residual)), lambda n: F.aggregate(F.slice(residual, 1, n), warm, lambda s, v: s + v))


def rice_bits(codes: Column, k: Column) -> Column:
    """Bits of the Rice codes with parameter k, and of the parameter itself."""
    return F.aggregate(codes, F.lit(4).cast("long"), lambda s, c: s + F.floor(c / F.pow(F.lit(2.0), k)).cast("long") + 1 + k)


def best_parameter(residual: Column) -> Column:
    """struct<bits, k>: the cheapest parameter of 0 to 14, the smallest of equals."""
    codes = F.transform(residual, zigzag)
    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(14)), lambda k: F.struct(rice_bits(codes, k).alias("bits"), k.alias("k"))))
