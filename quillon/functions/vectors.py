"""Vector arithmetic on array columns, in double precision.

Where one side is a literal query the sum is unrolled, so that it runs inside
generated code; between two columns it is a fold over the arrays.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNROLL = 512


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    """Over the shorter of the two."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def _number(x: Column) -> Column:
    """NaN, which would come before all others in an order, is an error."""
    return F.when(F.isnan(x), F.raise_error(F.lit("NaN in an embedding"))).otherwise(x)


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """dot over norms of the full vectors; 0 where a norm is 0; an error where it is NaN."""
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return _number(F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(length, F.lit(0.0))))


def cosine_to(q: Sequence[float], v: Column, norm_v: Column | None = None) -> Column:
    """cosine with a fixed query."""
    q = [float(x) for x in q]
    size = sum(x * x for x in q) ** 0.5
    if not size:
        return F.lit(0.0)
    if len(q) > UNROLL:
        return cosine(F.lit(q), v, F.lit(size), norm_v)
    terms = [F.coalesce(F.get(v, F.lit(i)).cast("double") * F.lit(x), F.lit(0.0)) for i, x in enumerate(q)]
    length = norm(v) if norm_v is None else norm_v
    return _number(F.when(length == 0, F.lit(0.0)).otherwise(reduce(lambda a, b: a + b, terms) / F.nullif(length * F.lit(size), F.lit(0.0))))
