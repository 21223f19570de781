"""Vector functions on arrays, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 for vectors of different length, empty or zero vectors."""
    n = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    fits = (F.size(a) == F.size(b)) & (n > 0)
    return F.when(fits, dot(a, b) / n).otherwise(0.0)


def overlap_ratio(query_tokens: Column, haystack: Column) -> Column:
    """Share of the distinct query tokens that occur in the haystack as substrings."""
    distinct = F.array_distinct(query_tokens)
    hits = F.size(F.filter(distinct, lambda t: haystack.contains(t)))
    return F.when(F.size(distinct) > 0, hits / F.size(distinct)).otherwise(0.0)
