"""Scalar quantisation to 8 bits a dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flat
from .topk import top

REFINE = 3  # candidates a result row, before the exact scores


def train(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """(pos, lo, step): least value and step of each dimension; a flat dimension gets the floor 1e-6 as its range."""
    parts = vectors.select(F.posexplode(column).alias("pos", "x")).where(~F.isnan("x"))
    spread = parts.groupBy("pos").agg(F.min(F.col("x").cast("double")).alias("lo"), F.max(F.col("x").cast("double")).alias("hi"))
    return spread.select("pos", "lo", (F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6)) / 255).alias("step"))


def params(trained: DataFrame) -> DataFrame:
    """One row (lo, step) of arrays, in the order of dimensions: as many values as dimensions, so it can be broadcast."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "lo", "step")))
    return trained.agg(rows.alias("r")).select(F.transform("r", lambda x: x["lo"]).alias("lo"), F.transform("r", lambda x: x["step"]).alias("step"))


def encode(v: Column, lo: Column, step: Column) -> Column:
    """Codes 0 to 255, rounded half up."""
    scaled = F.zip_with(F.zip_with(v, lo, lambda x, a: x.cast("double") - a), step, lambda x, s: x / s)
    return F.transform(scaled, lambda x: F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("smallint"))


def decode(code: Column, lo: Column, step: Column) -> Column:
    return F.zip_with(F.zip_with(code, step, lambda c, s: c * s), lo, lambda x, a: x + a)


def with_codes(table: DataFrame, trained: DataFrame, column: str = "vector") -> DataFrame:
    """table with code."""
    return table.crossJoin(F.broadcast(params(trained))).withColumn("code", encode(F.col(column), F.col("lo"), F.col("step"))).drop("lo", "step")


def best(coded: DataFrame, queries: DataFrame, trained: DataFrame, k: int) -> DataFrame:
    """(qid, score, approx, key): of each query the k best by approx, the dot product with the decoded vector; score is that with the vector.

    Blocks of queries against batches of decoded vectors (see flat.route): a task passes on only rows that may be among
    the best, and no vectors, so pairs are neither sorted nor written.
    """
    rows = coded.select("key", F.col("vector").alias("_stored"), "code").crossJoin(F.broadcast(params(trained)))
    return flat.route(rows.select("key", "_stored", decode(F.col("code"), F.col("lo"), F.col("step")).alias("vector")), queries, k, "_stored")


def two_stage(coded: DataFrame, queries: DataFrame, trained: DataFrame, k: int) -> DataFrame:
    """The best REFINE * k by codes, then exact scores from the vectors, cut at k."""
    return top(best(coded, queries, trained, REFINE * k), k, ["qid"]).select("qid", "rank", "key", "score")
