"""Vector arithmetic as native column expressions; sums are doubles, from left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Unit length, in floats; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: (x.cast("double") / n).cast("float"))).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def sanitize(score: Column) -> Column:
    """NaN counts as minus infinity, so that it ranks last."""
    return F.when(F.isnan(score), F.lit(float("-inf"))).otherwise(score)


def checked_dim(v: Column, dim: int) -> Column:
    """The vector, or an error at run time if its dimension is wrong."""
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"vector dimension is not {dim}: "), F.size(v).cast("string"))))


def parse_vector(text: Column) -> Column:
    """Comma-separated numbers to floats."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x).cast("float"))


def parse_pairs(text: Column) -> Column:
    """k=v,k=v to a map."""
    return F.str_to_map(text, F.lit(","), F.lit("="))
