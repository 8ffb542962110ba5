"""TF-IDF keyword search: the sum of tf * ln(1 + N / df) over the query's tokens, without length normalisation.

Scores are rounded to 9 decimals, so that ties do not depend on the order of a sum.
N counts documents with at least one token. Tokens that a query repeats count again. With a shard column, N and df are
those of the document's shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_token, idf, tokenize
from .topk import top


def postings(docs: DataFrame, shard: str | None = None) -> DataFrame:
    """(key, [shard], token, tf)."""
    by = ["key", *([shard] if shard else []), "token"]
    return docs.select("key", *([shard] if shard else []), F.explode(tokenize(F.col("text"))).alias("token")).groupBy(*by).agg(F.count(F.lit(1)).alias("tf"))


def statistics(docs: DataFrame, shard: str | None = None) -> DataFrame:
    """(n_docs) of the corpus, or (shard, n_docs)."""
    some = docs.where(has_token(F.col("text")))
    return (some.groupBy(shard) if shard else some.groupBy()).agg(F.count(F.lit(1)).alias("n_docs"))


def frequencies(posts: DataFrame, shard: str | None = None) -> DataFrame:
    """(token, [shard], df)."""
    return posts.groupBy("token", *([shard] if shard else [])).agg(F.count(F.lit(1)).alias("df"))


def scores(docs: DataFrame, queries: DataFrame, shard: str | None = None) -> DataFrame:
    """(qid, key, score) of every document with a token of the query; queries: (qid, text)."""
    wanted = queries.select("qid", F.explode(tokenize(F.col("text"))).alias("token")).groupBy("qid", "token").agg(F.count(F.lit(1)).alias("times"))
    # tokens that nobody asks for go before anything is counted by document
    posts = postings(docs, shard).join(wanted.select("token").distinct(), "token", "left_semi")
    by = [shard] if shard else []
    df = frequencies(posts, shard)
    total = statistics(docs, shard)
    weights = df.join(F.broadcast(total), by) if shard else df.crossJoin(F.broadcast(total))  # one row, or one a shard
    weights = weights.select("token", *by, idf(F.col("n_docs"), F.col("df")).alias("idf"))
    hits = posts.join(weights, ["token", *by]).join(wanted, "token")
    return hits.groupBy("qid", "key").agg(F.round(F.sum(F.col("times") * F.col("tf") * F.col("idf")), 9).alias("score"))


def search(docs: DataFrame, queries: DataFrame, k: int, shard: str | None = None) -> DataFrame:
    """(qid, rank, key, score)."""
    return top(scores(docs, queries, shard), k, ["qid"]).select("qid", "rank", "key", "score")
