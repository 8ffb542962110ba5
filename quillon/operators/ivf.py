"""Inverted files: vectors in lists by nearest centroid, queries probe the nearest lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import flat, kmeans, quantize
from .topk import top

SPLIT = 16  # files of one list at most, so that a list of a third of all rows is not one task's


def train_threshold(nlist: int) -> int:
    """Fewer vectors than this are searched without lists."""
    return max(39 * nlist, 100)


def build(table: DataFrame, nlist: int, iterations: int = kmeans.ITERATIONS) -> tuple[DataFrame, DataFrame]:
    """(table with cid, centroids). Write the first partitioned by cid, so that probes prune files."""
    centroids = kmeans.train(table.where(F.size("vector") > 0), nlist, iterations)
    return kmeans.assign(table, centroids), centroids


def store(lists: DataFrame, path: str) -> DataFrame:
    """lists written by cid and read back: a probe opens the files of its lists only."""
    lists.repartition("cid", F.pmod(F.xxhash64("key"), F.lit(SPLIT))).write.partitionBy("cid").parquet(path)
    return lists.sparkSession.read.schema(lists.schema).parquet(path)


def probes(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """(qid, qv, cid): the nprobe lists of the largest dot product; of equals the larger cid."""
    pairs = queries.crossJoin(F.broadcast(centroids)).withColumn("_s", V.dot(F.col("qv"), F.col("centroid")))
    w = Window.partitionBy("qid").orderBy(F.desc("_s"), F.desc("cid"))
    return pairs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= nprobe).select("qid", "qv", "cid")


def candidates(lists: DataFrame, queries: DataFrame, centroids: DataFrame, nprobe: int, stored: bool = False) -> DataFrame:
    """Rows of the probed lists with qid and qv. Lists of cid -1 (no centroid) are always probed.

    Of stored lists (see ``store``) the probed numbers, at most one a centroid, are a filter that leaves out the other files.
    """
    probed = probes(queries, centroids, nprobe)
    if stored:
        wanted = [r[0] for r in probed.select("cid").distinct().collect()]
        lists = lists.where(F.col("cid").isin(-1, *wanted))
    lost = queries.select("qid", "qv", F.lit(-1).alias("cid"))
    return lists.join(F.broadcast(probed.unionByName(lost)), "cid")  # queries x (nprobe + 1) rows


def search(lists: DataFrame, queries: DataFrame, centroids: DataFrame, nprobe: int, k: int, stored: bool = False) -> DataFrame:
    return flat.rerank(candidates(lists, queries, centroids, nprobe, stored), k).select("qid", "rank", "key", "score")


def search_sq8(lists: DataFrame, queries: DataFrame, centroids: DataFrame, trained: DataFrame, nprobe: int, k: int) -> DataFrame:
    """lists with code: the probed rows are ranked by their codes, the best REFINE * k by their vectors."""
    near = candidates(lists, queries, centroids, nprobe).crossJoin(F.broadcast(quantize.params(trained)))
    near = near.withColumn("approx", V.sanitize(V.dot(F.col("qv"), quantize.decode(F.col("code"), F.col("lo"), F.col("step")))))
    near = top(near, quantize.REFINE * k, ["qid"], "approx", "key", "_c")
    return flat.rerank(near, k).select("qid", "rank", "key", "score")


def stats(lists: DataFrame) -> DataFrame:
    """(cid, n): live vectors of each list."""
    return lists.groupBy("cid").agg(F.count(F.lit(1)).alias("n"))
