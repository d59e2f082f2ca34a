"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    """The vector in double precision."""
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    """Sum of the components."""
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def unit(v: Column) -> Column:
    """The vector at length one; lengths below 1e-12 count as 1e-12, so the zero vector stays zero."""
    length = F.greatest(F.sqrt(total(F.transform(v, lambda x: x * x))), F.lit(1e-12))
    return F.transform(v, lambda x: x / length)


def usable(v: Column, dim: int) -> Column:
    """Exactly ``dim`` finite components that are not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0)


def last_token(hidden: Column, mask: Column, left_padded: Column) -> Column:
    """Vector of the last real token: the last one in a left-padded batch, else the one that the mask's sum points to."""
    real = F.aggregate(mask, F.lit(0), lambda acc, x: acc + x.cast("int"))
    return F.when(left_padded, F.element_at(hidden, -1)).otherwise(F.try_element_at(hidden, F.greatest(real, F.lit(1))))
