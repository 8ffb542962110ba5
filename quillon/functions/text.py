"""Tokens and TF-IDF weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tokenize(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased; everything else separates. Null gives no tokens."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), "[^a-z0-9]+"), "")


def has_token(text: Column) -> Column:
    return F.coalesce(text.rlike("[A-Za-z0-9]"), F.lit(False))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + n_docs / F.greatest(df, F.lit(1)))
