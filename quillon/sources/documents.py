"""JSON sources and sinks of the search contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig, InvalidArgument

RECORD = "key string, vector array<float>, metadata map<string,string>, text string"
DATASET = f"config struct<dim:int,num_shards:int,index_type:string,global_seed:bigint,contract_version:int>, records array<struct<{', '.join(':'.join(x.split()) for x in RECORD.split(', '))}>>"
POLICY = "struct<max_latency_ms:int,max_candidates:int,recall_bias:double,fusion_method:string>"
QUERY_FILE = f"queries array<struct<vector:array<float>,text_query:string,topk:int,alpha:double,policy:{POLICY}>>"
EXPECTED = "results array<struct<results:array<struct<key:string,score:double>>>>"
TOLERANCE = 1e-4


def read_dataset(spark: SparkSession, path: str) -> tuple[EngineConfig, DataFrame]:
    """The settings, and the records as (key, vector, meta, text)."""
    whole = spark.read.schema(DATASET).option("multiLine", True).json(path)
    c = whole.select("config.*").first()
    if c is None or c["dim"] is None:
        raise InvalidArgument(f"no config in {path}")
    cfg = EngineConfig(dim=c["dim"], num_shards=c["num_shards"] or 1, index=c["index_type"] or "flat", global_seed=c["global_seed"] or 0, contract_version=c["contract_version"] or 3)
    rows = whole.select(F.explode("records").alias("r")).select("r.key", "r.vector", F.col("r.metadata").alias("meta"), "r.text")
    return cfg.checked(), rows


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, qv, text, topk, alpha, policy); qid is the place in the file."""
    whole = spark.read.schema(QUERY_FILE).option("multiLine", True).json(path)
    return whole.select(F.posexplode("queries").alias("qid", "q")).select("qid", F.col("q.vector").alias("qv"), F.col("q.text_query").alias("text"), "q.topk", "q.alpha", "q.policy")


def write_expected(results: DataFrame, path: str) -> None:
    """results (qid, rank, key, score) as one JSON line for each query."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "key", "score")))
    per = results.groupBy("qid").agg(F.transform(rows, lambda r: F.struct(r["key"].alias("key"), r["score"].alias("score"))).alias("results"))
    per.select(F.to_json(F.struct("qid", "results")).alias("value")).write.mode("errorifexists").text(path)


def read_expected(spark: SparkSession, path: str) -> DataFrame:
    """(qid, rank, key, score) of write_expected."""
    rows = spark.read.schema("qid int, results array<struct<key:string,score:double>>").json(path)
    return rows.select("qid", F.posexplode("results").alias("p", "r")).select("qid", (F.col("p") + 1).alias("rank"), "r.key", "r.score")


def differences(results: DataFrame, expected: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows where key or score differ, or that one side lacks. Empty if the contract holds."""
    e = expected.select("qid", "rank", F.col("key").alias("want_key"), F.col("score").alias("want_score"))
    both = results.select("qid", "rank", "key", "score").join(e, ["qid", "rank"], "full_outer")
    same = F.col("key").eqNullSafe(F.col("want_key")) & (F.abs(F.col("score") - F.col("want_score")) <= tolerance)
    return both.where(~F.coalesce(same, F.lit(False)))


def write_jsonl(table: DataFrame, path: str) -> None:
    """One JSON object a line for each record."""
    table.select(F.to_json(F.struct(*table.columns)).alias("value")).write.mode("errorifexists").text(path)
