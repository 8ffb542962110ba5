"""Evaluation of approximate results against true ones: frames of (qid, rank, key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall(approx: DataFrame, truth: DataFrame, k: int | None = None) -> DataFrame:
    """(qid, recall): found truth over truth, or over k if given."""
    hits = truth.join(approx.select("qid", "key", F.lit(1).alias("hit")), ["qid", "key"], "left")
    below = F.count(F.lit(1)) if k is None else F.lit(k)
    return hits.groupBy("qid").agg((F.count("hit") / below).alias("recall"))


def self_recall(results: DataFrame) -> DataFrame:
    """One row: the share of queries whose first result is themselves."""
    first = results.where("rank = 1")
    return first.agg(F.avg((F.col("key") == F.col("qid").cast("string")).cast("int")).alias("recall_at_1"))


def percentile(df: DataFrame, column: str, p: float, by: list[str] | None = None) -> DataFrame:
    """Nearest rank: the value at floor(p * (n - 1)) of the sorted values, for each group."""
    by = by or []
    w = Window.partitionBy(*by)
    placed = df.where(F.col(column).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(column)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return placed.where(F.col("_r") == F.floor(F.lit(p) * (F.col("_n") - 1))).select(*by, F.col(column).alias("value"))


def within_budget(ms: Column, budget: float = 10.0) -> Column:
    return F.avg((ms <= budget).cast("int"))
