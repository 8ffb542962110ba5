"""Ranking by score, then key: one total order everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank(df: DataFrame, by: list[str], score: str = "score", key: str = "key", name: str = "rank") -> DataFrame:
    """Ranks from 1 within by: score down, then key up."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.asc(key))))


def top(df: DataFrame, k: int, by: list[str], score: str = "score", key: str = "key", name: str = "rank") -> DataFrame:
    """The first k of each group. Spark cuts each partition before the shuffle (WindowGroupLimit)."""
    return rank(df, by, score, key, name).where(F.col(name) <= k)


def sharded_merge(df: DataFrame, k: int, by: list[str], shard: str = "shard") -> DataFrame:
    """A cut in each shard, then over all: the same rows as one cut."""
    local = top(df, k, [*by, shard], name="_local").drop("_local")
    return top(local, k, by)
