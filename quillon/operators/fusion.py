"""Hybrid fusion of a vector side and a keyword side, each (qid, key, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .topk import rank, top

RRF = 60


def union(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """(qid, key, v, t, rv, rt): scores and ranks of both sides; a missing side is null. Joined on the key."""
    v = rank(vector, ["qid"], name="rv").select("qid", "key", F.col("score").alias("v"), "rv")
    t = rank(keyword, ["qid"], name="rt").select("qid", "key", F.col("score").alias("t"), "rt")
    return v.join(t, ["qid", "key"], "full_outer")


def fuse(both: DataFrame, method: str = "weighted_sum", alpha: float = 0.5) -> DataFrame:
    """both with score. weighted_sum: alpha * v + (1 - alpha) * t on raw scores, a missing one is 0. rrf: reciprocal ranks, a missing rank is one past the union."""
    if method == "rrf":
        past = F.count(F.lit(1)).over(Window.partitionBy("qid")) + 1
        part = lambda r: F.lit(1.0) / (RRF + F.coalesce(F.col(r), past))
        return both.withColumn("score", part("rv") + part("rt"))
    zero = F.lit(0.0)
    return both.withColumn("score", alpha * F.coalesce("v", zero) + (1 - alpha) * F.coalesce("t", zero))


def simple(vector: DataFrame, keyword: DataFrame, k: int, alpha: float, passes: DataFrame | None = None) -> DataFrame:
    """Each side cut at 2k, fused by weighted sum, filtered (keys of passes) last, cut at k."""
    fused = fuse(union(top(vector, 2 * k, ["qid"]), top(keyword, 2 * k, ["qid"])), "weighted_sum", alpha)
    if passes is not None:
        fused = fused.join(passes.select("key"), "key", "left_semi")
    return top(fused, k, ["qid"]).select("qid", "rank", "key", "score")


def stage_budget(k: int, max_candidates: int = 0) -> int:
    most = max(max_candidates or 2 * k, k)
    return min(most, 2 * k)


def staged(vector: DataFrame, keyword: DataFrame, k: int, method: str = "weighted_sum", alpha: float = 0.5, max_candidates: int = 0) -> DataFrame:
    """Both sides (already filtered) cut at the stage budget, fused, cut at k, with explain columns."""
    s = stage_budget(k, max_candidates)
    fused = fuse(union(top(vector, s, ["qid"]), top(keyword, s, ["qid"])), method, alpha)
    out = top(fused, k, ["qid"])
    zero = F.lit(0.0)
    return out.select("qid", "rank", "key", "score", F.coalesce("v", zero).alias("vector_score_raw"), F.coalesce("t", zero).alias("keyword_score_raw"), F.coalesce("rv", F.lit(0)).alias("rank_before"), F.col("rank").alias("rank_after"), F.lit(method).alias("fusion_method"))
