"""Vector expressions over arrays."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    square = lambda d: d * d
    return F.aggregate(F.zip_with(a, b, lambda x, y: square(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def truncated(v: Column, dimension: int) -> Column:
    return F.slice(v, 1, dimension)


def masked_mean(states: Column, mask: Column) -> Column:
    """Mean over the rows of an array of vectors whose mask is not 0; all masked: zeros."""
    kept = F.transform(F.filter(F.arrays_zip(states.alias("v"), mask.alias("m")), lambda x: x["m"] != 0), lambda x: x["v"])
    n = F.greatest(F.size(kept), F.lit(1))
    zero = F.transform(F.element_at(states, 1), lambda _: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / n)
