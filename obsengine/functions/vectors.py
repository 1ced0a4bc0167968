"""Column functions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is (nearly) zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size < 1e-9, 0.0).otherwise(dot(a, b) / size)


def softmax(values: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(values)
    powers = F.transform(values, lambda v: F.exp((v - top) / temperature))
    sums = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    once = F.array(F.struct(powers.alias("p"), sums.alias("s")))  # bound, so that the sum isn't taken again for each element
    return F.flatten(F.transform(once, lambda o: F.transform(o["p"], lambda p: p / o["s"])))


def argmax(values: Column) -> Column:
    """The first place, from zero, of the largest value."""
    return F.array_position(values, F.array_max(values)) - 1
