"""python -m quillon.cli contract-record|contract-verify DATASET QUERIES EXPECTED"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import QueryPolicy
from .engine import SearchEngine
from .sources import documents


def run_contract(spark: SparkSession, dataset: str, queries: str) -> DataFrame:
    """(qid, rank, key, score) of every query of a query file."""
    cfg, rows = documents.read_dataset(spark, dataset)
    engine = SearchEngine(spark, cfg)
    engine.upsert(rows)
    out = None
    for q in documents.read_queries(spark, queries).orderBy("qid").collect():  # a contract file is small
        p = q["policy"]
        policy = QueryPolicy(p["max_latency_ms"] or 0, p["max_candidates"] or 0, p["recall_bias"] or 0.0, p["fusion_method"] or "weighted_sum") if p else QueryPolicy()
        vector = list(q["qv"]) if q["qv"] else None
        one = engine.search_hybrid_with_explain(vector, q["text"], q["topk"], 0.5 if q["alpha"] is None else q["alpha"], policy) if q["text"] else engine.search([vector], q["topk"])
        one = one.select(F.lit(q["qid"]).alias("qid"), "rank", "key", "score")
        out = one if out is None else out.unionByName(one)
    return out


def main(args: list[str]) -> int:
    command, dataset, queries, expected = args
    spark = SparkSession.builder.appName("quillon").getOrCreate()
    found = run_contract(spark, dataset, queries)
    if command == "contract-record":
        documents.write_expected(found, expected)
        return 0
    wrong = documents.differences(found, documents.read_expected(spark, expected)).collect()
    print("\n".join(map(str, wrong)) or "contract holds")
    return int(bool(wrong))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
