"""Named queries over the test tables: name -> (function, DuckDB SQL or None).

Vectors are ``embeddings`` (key: vec_id as string, tag: label); the hybrid corpus joins ``documents`` on doc_id = vec_id;
``events`` is read as a mutation log (key: user_id, deletes: event_type error, ttl from value). Searches take every row whose id
is divisible by 100 as a query, against all rows; the texts of all benchmark items are the keyword queries.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..engine import SearchEngine
from ..functions import vectors as V
from ..functions.hashing import fnv_hex, shard_of
from ..functions.text import idf, tokenize
from ..operators import evaluate, filters, flat, fusion, hnsw, ivf, keyword, kmeans, mutations, quantize
from ..operators.topk import sharded_merge, top
from ..sources.shared import shared_folder

K = 10
EACH = 100  # one row in so many is a query
AS_OF = "2024-01-15 00:00:00"


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("key"), F.col("embedding").alias("vector"), F.create_map(F.lit("tag"), F.col("label").cast("string")).alias("meta"))


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "embeddings").where(F.col("vec_id") % EACH == 0)
    return e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))


def hybrid_corpus(spark: SparkSession, sf: str) -> DataFrame:
    both = _read(spark, sf, "documents").join(_read(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    meta = F.create_map(F.lit("tag"), F.col("label").cast("string"), F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    return both.select(F.col("doc_id").cast("string").alias("key"), F.col("embedding").alias("vector"), meta.alias("meta"), "text")


def text_queries(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _out(df: DataFrame) -> DataFrame:
    return df.select("qid", F.col("rank").cast("int").alias("rank"), "key", F.round("score", 6).alias("score"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector with every query and its score."""
    pairs = vectors(spark, sf).crossJoin(F.broadcast(vector_queries(spark, sf)))
    return pairs.withColumn("score", V.sanitize(V.dot(F.col("vector"), F.col("qv"))))


_Q = "q AS (SELECT vec_id AS qid, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0)"
_S = "s AS (SELECT qid, vec_id::VARCHAR AS key, label, qv, embedding, list_dot_product(qv::DOUBLE[], embedding::DOUBLE[]) AS score FROM embeddings, q)"
_TOP = "SELECT qid, rank::INT AS rank, key, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM {0}) WHERE rank <= {1}"


def flat_topk_dot(spark: SparkSession, sf: str) -> DataFrame:
    return _out(flat.search(vectors(spark, sf), vector_queries(spark, sf), K, 40))


def flat_topk_cosine(spark: SparkSession, sf: str) -> DataFrame:
    scaled = vectors(spark, sf).withColumn("vector", F.transform("vector", lambda x: (x * (1 + F.pmod(F.col("key").cast("int"), F.lit(3)))).cast("float")))
    unit = scaled.withColumn("raw", F.col("vector")).withColumn("vector", V.normalize(F.col("vector")))
    near = flat.route(unit, vector_queries(spark, sf), 40)
    return _out(top(near.withColumn("score", V.cosine(F.col("raw"), F.col("qv"))), K, ["qid"]))


_COSINE = f"WITH {_Q}, c AS (SELECT qid, vec_id::VARCHAR AS key, list_transform(embedding, lambda x: (x * (1 + vec_id % 3))::FLOAT)::DOUBLE[] AS v, qv::DOUBLE[] AS qv FROM embeddings, q), s AS (SELECT qid, key, list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv))) AS score FROM c) {_TOP.format('s', K)}"


def search_by_key(spark: SparkSession, sf: str) -> DataFrame:
    table = vectors(spark, sf)
    queries = table.where(F.col("key").cast("int") % EACH == 0).select(F.col("key").alias("qid"), F.col("vector").alias("qv"))
    return _out(flat.search(table, queries, K, 40))


def filtered_pre(spark: SparkSession, sf: str) -> DataFrame:
    return _out(flat.search(filters.live(vectors(spark, sf), filters={"tag": "3"}), vector_queries(spark, sf), K, 40))


def filtered_post(spark: SparkSession, sf: str) -> DataFrame:
    near = flat.search(vectors(spark, sf), vector_queries(spark, sf), 40)
    return _out(top(near.drop("rank").where(filters.metadata({"tag": "3"})), K, ["qid"]))


def candidate_bound_rerank(spark: SparkSession, sf: str) -> DataFrame:
    near = top(_scored(spark, sf), 40, ["qid"], name="_c").select("qid", "key", "qv")
    back = near.join(vectors(spark, sf).select("key", "vector"), "key")
    return _out(flat.rerank(back, K))


def shard_route(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("key")
    return vectors(spark, sf).select("key", fnv_hex(key).alias("hash"), shard_of(key, 4).alias("shard"))


_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i])::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"
_SHARDS = f"f AS (SELECT vec_id::VARCHAR AS key, {_FNV.format('(vec_id::VARCHAR)')} AS h FROM embeddings)"


def sharded_merge_query(spark: SparkSession, sf: str) -> DataFrame:
    return _out(sharded_merge(_scored(spark, sf).withColumn("shard", shard_of(F.col("key"), 4)), K, ["qid"]))


def norm_stats(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "embeddings").withColumn("n", V.norm(F.col("embedding"))).withColumn("u", V.norm(V.normalize(F.col("embedding"))))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("n"), 6).alias("min_norm"), F.round(F.max("n"), 6).alias("max_norm"), F.round(F.avg("u"), 5).alias("unit_norm"))


_DT = "list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[^A-Za-z0-9]+'), lambda x: x <> ''), lambda x: lower(x))"
_KW = f"""p AS (SELECT doc_id::VARCHAR AS key, token, count(*) AS tf FROM (SELECT doc_id, unnest({_DT}) AS token FROM documents) GROUP BY 1, 2),
n AS (SELECT count(DISTINCT key) AS n FROM p), df AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
w AS (SELECT item_id AS qid, token, count(*) AS times FROM (SELECT item_id, unnest({_DT}) AS token FROM benchmark) GROUP BY 1, 2),
k AS (SELECT qid, key, round(sum(times * tf * ln(1 + n / df::DOUBLE)), 9) AS score FROM w JOIN p USING (token) JOIN df USING (token), n GROUP BY 1, 2)"""


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("key"), "text")


def tokenize_tf(spark: SparkSession, sf: str) -> DataFrame:
    return keyword.postings(_docs(spark, sf)).select("key", "token", "tf")


def doc_freq_idf(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    df = keyword.frequencies(keyword.postings(docs)).crossJoin(F.broadcast(keyword.statistics(docs)))
    return df.select("token", "df", F.round(idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


def keyword_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _keyword_out(keyword.search(_docs(spark, sf), text_queries(spark, sf), K))


def _keyword_out(df: DataFrame) -> DataFrame:
    return df.select("qid", F.col("rank").cast("int").alias("rank"), "key", F.round("score", 4).alias("score"))


def keyword_shard_idf(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).withColumn("shard", F.pmod(F.col("key").cast("long"), F.lit(3)).cast("int"))
    return _keyword_out(keyword.search(docs, text_queries(spark, sf), K, "shard"))


_KW_SHARD = f"""p AS (SELECT doc_id::VARCHAR AS key, doc_id % 3 AS shard, token, count(*) AS tf FROM (SELECT doc_id, unnest({_DT}) AS token FROM documents) GROUP BY 1, 2, 3),
n AS (SELECT shard, count(DISTINCT key) AS n FROM p GROUP BY 1), df AS (SELECT token, shard, count(*) AS df FROM p GROUP BY 1, 2),
w AS (SELECT item_id AS qid, token, count(*) AS times FROM (SELECT item_id, unnest({_DT}) AS token FROM benchmark) GROUP BY 1, 2),
k AS (SELECT qid, key, round(sum(times * tf * ln(1 + n / df::DOUBLE)), 9) AS score FROM w JOIN p USING (token) JOIN df USING (token, shard) JOIN n USING (shard) GROUP BY 1, 2)"""
_RANK4 = "SELECT qid, rank::INT AS rank, key, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM {0}) WHERE rank <= {1}"


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The hybrid corpus, and both sides' scores: vec_id's vector with item_id's text."""
    corpus = hybrid_corpus(spark, sf)
    v = flat.search(corpus.select("key", "vector"), vector_queries(spark, sf), 2 * K, 80).select("qid", "key", "score")
    t = keyword.scores(corpus, text_queries(spark, sf))
    return corpus, v, t


_HC = f"""c AS (SELECT doc_id::VARCHAR AS key, embedding, text, source, lang, label FROM documents JOIN embeddings ON doc_id = vec_id), {_Q},
vs AS (SELECT qid, key, list_dot_product(qv::DOUBLE[], embedding::DOUBLE[]) AS score FROM c, q),
v AS (SELECT qid, key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rv FROM vs QUALIFY rv <= 20),
p AS (SELECT key, token, count(*) AS tf FROM (SELECT key, unnest({_DT}) AS token FROM c) GROUP BY 1, 2),
n AS (SELECT count(DISTINCT key) AS n FROM p), df AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
w AS (SELECT item_id AS qid, token, count(*) AS times FROM (SELECT item_id, unnest({_DT}) AS token FROM benchmark) GROUP BY 1, 2),
ts AS (SELECT qid, key, round(sum(times * tf * ln(1 + n / df::DOUBLE)), 9) AS score FROM w JOIN p USING (token) JOIN df USING (token), n GROUP BY 1, 2),
t AS (SELECT qid, key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rt FROM ts QUALIFY rt <= 20),
u AS (SELECT coalesce(v.qid, t.qid) AS qid, coalesce(v.key, t.key) AS key, v.score AS v, t.score AS t, rv, rt FROM v FULL JOIN t ON v.qid = t.qid AND v.key = t.key)"""


def hybrid_weighted(spark: SparkSession, sf: str) -> DataFrame:
    corpus, v, t = _sides(spark, sf)
    return _keyword_out(fusion.simple(v, t, K, 0.7, filters.live(corpus, filters={"lang": "en"})))


def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    _, v, t = _sides(spark, sf)
    return _out(fusion.staged(v, t, K, "rrf"))


def hybrid_staged_explain(spark: SparkSession, sf: str) -> DataFrame:
    _, v, t = _sides(spark, sf)
    out = fusion.staged(v, t, K, "weighted_sum", 0.4)
    return out.select("qid", F.col("rank").cast("int").alias("rank"), "key", *[F.round(c, 4).alias(c) for c in ("score", "vector_score_raw", "keyword_score_raw")], F.col("rank_before").cast("int").alias("rank_before"), F.col("rank_after").cast("int").alias("rank_after"), "fusion_method")


def log(spark: SparkSession, sf: str) -> DataFrame:
    """events as a mutation log: entries of error delete, others expire after value hours."""
    e = _read(spark, sf, "events")
    e = e.select(F.col("user_id").cast("string").alias("key"), F.col("ts").alias("seq"), F.col("event_id").alias("n"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.when(F.col("value") > 20, F.floor(F.col("value") * 3_600_000)).otherwise(F.lit(-1)).cast("long").alias("ttl_ms"), "event_type")
    return mutations.with_expiry(e, "seq", "ttl_ms")


_ORDER = ["seq", "n"]
_LOG = """l AS (SELECT user_id::VARCHAR AS key, ts AS seq, event_id AS n, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, event_type,
CASE WHEN value > 20 THEN ts + to_milliseconds(floor(value * 3600000)::BIGINT) END AS expires_at FROM events),
t AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC, n DESC) = 1)"""


def latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    return mutations.latest(log(spark, sf), _ORDER).select("key", "n", "op")


def tombstone_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    last = mutations.latest(log(spark, sf), _ORDER)
    return mutations.delete_keys(last, last.where("op = 'delete'")).select("key", "n")


def _as_of() -> Column:
    return F.to_timestamp_ntz(F.lit(AS_OF))


def ttl_live(spark: SparkSession, sf: str) -> DataFrame:
    out = mutations.live(log(spark, sf), _ORDER, _as_of())
    return out.select("key", "n", mutations.remaining_ttl(_as_of()).cast("long").alias("ttl_left"))


def export_records(spark: SparkSession, sf: str) -> DataFrame:
    corpus = hybrid_corpus(spark, sf)
    out = mutations.export(corpus, {"lang": "en", "source": "src3"})
    return out.select("key", F.col("meta")["tag"].alias("tag"), F.length("text").cast("long").alias("n_chars"), F.size("vector").cast("long").alias("dim"))


def engine_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = mutations.stats(log(spark, sf), 64, _ORDER)
    return s.withColumn("stale_ratio", F.round("stale_ratio", 6))


def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    h = mutations.latency_histogram(_read(spark, sf, "events"), "value")
    return h.select(F.col("bucket").cast("int").alias("bucket"), "upper", "n")


_BUCKET = "CASE " + " ".join(f"WHEN value <= {b} THEN {i}" for i, b in enumerate(mutations.LATENCY_BOUNDS)) + f" ELSE {len(mutations.LATENCY_BOUNDS)} END"
_UPPER = "CASE " + " ".join(f"WHEN bucket = {i} THEN {b}" for i, b in enumerate(mutations.LATENCY_BOUNDS)) + " END::DOUBLE"


def sq8_train(spark: SparkSession, sf: str) -> DataFrame:
    t = quantize.train(vectors(spark, sf))
    return t.select(F.col("pos").cast("int").alias("pos"), F.round("lo", 9).alias("lo"), F.round("step", 9).alias("step"))


_SQ = """x AS (SELECT vec_id::VARCHAR AS key, embedding, i AS pos, embedding[i + 1]::DOUBLE AS x FROM embeddings, unnest(range(0, len(embedding))) AS g(i)),
r AS (SELECT pos, min(x) AS lo, greatest(max(x) - min(x), 1e-6) / 255 AS step FROM x GROUP BY 1),
c AS (SELECT key, pos, x, lo, step, floor(least(greatest((x - lo) / step, 0), 255) + 0.5)::BIGINT AS code FROM x JOIN r USING (pos))"""


def sq8_encode(spark: SparkSession, sf: str) -> DataFrame:
    table = vectors(spark, sf)
    coded = quantize.with_codes(table, quantize.train(table))
    return coded.select("key", F.aggregate("code", F.lit(0).cast("long"), lambda s, c: s + c).alias("code_sum"), F.array_max("code").cast("long").alias("code_max"), F.size("code").cast("long").alias("dim"))


def sq8_approx_topk(spark: SparkSession, sf: str) -> DataFrame:
    table = vectors(spark, sf)
    trained = quantize.train(table)
    near = quantize.best(quantize.with_codes(table, trained), vector_queries(spark, sf), trained, K)
    return _out(top(near.withColumn("score", F.col("approx")), K, ["qid"]))


def sq8_two_stage(spark: SparkSession, sf: str) -> DataFrame:
    table = vectors(spark, sf)
    trained = quantize.train(table)
    return _out(quantize.two_stage(quantize.with_codes(table, trained), vector_queries(spark, sf), trained, K))


_SQ_APPROX = f"{_SQ}, {_Q}, qx AS (SELECT qid, i AS pos, qv[i + 1]::DOUBLE AS qx FROM q, unnest(range(0, len(qv))) AS g(i)), a AS (SELECT qid, key, sum(qx * (lo + code * step)) AS score FROM c JOIN qx USING (pos) GROUP BY 1, 2)"


def given_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """The unit-length mean of each label: centroids that SQL can make too."""
    e = _read(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = e.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("m"))
    unit = F.transform("m", lambda x: x / V.norm(F.col("m")))
    return rows.select(F.col("label").cast("int").alias("cid"), unit.alias("centroid"))


_CENT = """m AS (SELECT label AS cid, pos, avg(x) AS x FROM (SELECT label, i AS pos, embedding[i + 1]::DOUBLE AS x FROM embeddings, unnest(range(0, len(embedding))) AS g(i)) GROUP BY 1, 2),
ce AS (SELECT cid, list(x ORDER BY pos) AS m FROM m GROUP BY 1), ct AS (SELECT cid, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS centroid FROM ce),
al AS (SELECT vec_id::VARCHAR AS key, embedding, cid, row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(embedding::DOUBLE[], centroid) DESC, cid) AS rn FROM embeddings, ct),
li AS (SELECT key, embedding, cid FROM al WHERE rn = 1)"""
_PROBE = f"{_CENT}, {_Q}, pr AS (SELECT qid, qv, cid FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY list_dot_product(qv::DOUBLE[], centroid) DESC, cid DESC) AS rn FROM q, ct) WHERE rn <= 3)"


def centroid_assign(spark: SparkSession, sf: str) -> DataFrame:
    return kmeans.assign(vectors(spark, sf), given_centroids(spark, sf)).select("key", F.col("cid").cast("int").alias("cid"))


def kmeans_one_step(spark: SparkSession, sf: str) -> DataFrame:
    moved = kmeans.step(vectors(spark, sf), given_centroids(spark, sf))
    return moved.select("cid", F.posexplode("centroid").alias("pos", "x")).select("cid", F.col("pos").cast("int").alias("pos"), (F.round(F.col("x").cast("double"), 3) + 0.0).alias("x"))


_STEP = f"{_CENT}, z AS (SELECT cid, i AS pos, avg(embedding[i + 1]::DOUBLE) AS x FROM li, unnest(range(0, len(embedding))) AS g(i) GROUP BY 1, 2), zn AS (SELECT cid, sqrt(sum(x * x)) AS n FROM z GROUP BY 1)"


def ivf_probe_topk(spark: SparkSession, sf: str) -> DataFrame:
    centroids = given_centroids(spark, sf)
    return _out(ivf.search(kmeans.assign(vectors(spark, sf), centroids), vector_queries(spark, sf), centroids, 3, K))


def ivf_sq8_topk(spark: SparkSession, sf: str) -> DataFrame:
    table, centroids = vectors(spark, sf), given_centroids(spark, sf)
    trained = quantize.train(table)
    lists = kmeans.assign(quantize.with_codes(table, trained), centroids)
    return _out(ivf.search_sq8(lists, vector_queries(spark, sf), centroids, trained, 3, K))


def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.recall(ivf_probe_topk(spark, sf), flat_topk_dot(spark, sf)).select("qid", F.round("recall", 6).alias("recall"))


def percentile_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "events")
    out = None
    for p in (0.5, 0.95, 0.99):
        part = evaluate.percentile(e, "value", p, ["event_type"]).withColumn("p", F.lit(p))
        out = part if out is None else out.unionByName(part)
    return out.select("event_type", "p", "value")


def duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of vectors of score above 0.95, in both orders."""
    kind = _read(spark, sf, "embeddings").schema["vec_id"].dataType
    return flat.above(vectors(spark, sf), 0.95).select(F.col("qid").cast(kind).alias("qid"), "key", F.round("score", 6).alias("score"))


def _trained(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of each query in 5 of 10 trained lists, which are stored and read back."""
    table = vectors(spark, sf)
    lists, centroids = ivf.build(table, 10)
    lists = ivf.store(lists, f"{shared_folder(spark)}/lists-{uuid.uuid4().hex}")
    queries = vector_queries(spark, sf)
    return evaluate.recall(ivf.search(lists, queries, centroids, 5, K, True), flat.search(table, queries, K, 40))


def ivf_trained(spark: SparkSession, sf: str) -> DataFrame:
    return _trained(spark, sf)


def ivf_recall(spark: SparkSession, sf: str) -> DataFrame:
    """One row: whether half of the trained lists hold on average 0.7 or more of the true neighbours."""
    return _trained(spark, sf).agg(F.count(F.lit(1)).alias("n_queries"), (F.avg("recall") >= 0.7).alias("holds"))


def _graph(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates' best K of graphs, two or as many as the vectors need; the graphs are stored and read back."""
    table = vectors(spark, sf).select("key", "vector")
    n = hnsw.shards(table, 2)
    at = f"{shared_folder(spark)}/graphs-{uuid.uuid4().hex}"
    hnsw.build(table, n, 16, 100).write.parquet(at)
    return hnsw.search(table, spark.read.schema(hnsw.EDGES).parquet(at), vector_queries(spark, sf), n, K, 40, 80)


def hnsw_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _out(_graph(spark, sf))


def hnsw_recall(spark: SparkSession, sf: str) -> DataFrame:
    """One row: whether the graphs find on average 0.95 or more of the true neighbours."""
    found = evaluate.recall(_graph(spark, sf), flat.search(vectors(spark, sf).select("key", "vector"), vector_queries(spark, sf), K, 40))
    return found.agg(F.count(F.lit(1)).alias("n_queries"), (F.avg("recall") >= 0.95).alias("holds"))


def self_match(spark: SparkSession, sf: str) -> DataFrame:
    """The share of queries whose first result is themselves."""
    table, queries = vectors(spark, sf), vector_queries(spark, sf)
    return evaluate.self_recall(flat.search(table, queries, K, 40))


def engine_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    """filtered_pre through the engine: upsert, filter before the cut, exact scores."""
    engine = SearchEngine(spark, EngineConfig(dim=64, similarity="dot"))
    engine.upsert(vectors(spark, sf))
    return _out(engine.search(vector_queries(spark, sf), K, {"tag": "3"}, filter_mode="pre"))


def engine_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    """flat_topk_dot by an engine that was saved and loaded."""
    engine = SearchEngine(spark, EngineConfig(dim=64, similarity="dot"))
    engine.upsert(vectors(spark, sf))
    path = f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    engine.save(path)
    return _out(SearchEngine.load(spark, path).search(vector_queries(spark, sf), K))


def _w(*parts: str) -> str:
    return "WITH " + ", ".join(parts)


QUERIES = {
    "flat_topk_dot": (flat_topk_dot, f"{_w(_Q, _S)} {_TOP.format('s', K)}"),
    "flat_topk_cosine": (flat_topk_cosine, _COSINE),
    "search_by_key": (search_by_key, f"WITH q AS (SELECT vec_id::VARCHAR AS qid, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0), {_S} {_TOP.format('s', K)}"),
    "filtered_pre": (filtered_pre, f"{_w(_Q, _S)} {_TOP.format('(SELECT * FROM s WHERE label = 3)', K)}"),
    "filtered_post": (filtered_post, f"{_w(_Q, _S)}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS cut FROM s) WHERE cut <= 40) {_TOP.format('(SELECT * FROM c WHERE label = 3)', K)}"),
    "candidate_bound_rerank": (candidate_bound_rerank, f"{_w(_Q, _S)} {_TOP.format('s', K)}"),
    "shard_route": (shard_route, f"WITH {_SHARDS} SELECT key, lower(lpad(to_hex(h::UHUGEINT), 16, '0')) AS hash, (h % 4)::INT AS shard FROM f"),
    "sharded_merge": (sharded_merge_query, f"{_w(_Q, _S)} {_TOP.format('s', K)}"),
    "norm_stats": (norm_stats, "SELECT label, count(*) AS n, round(min(sqrt(list_dot_product(e, e))), 6) AS min_norm, round(max(sqrt(list_dot_product(e, e))), 6) AS max_norm, 1.0::DOUBLE AS unit_norm FROM (SELECT label, embedding::DOUBLE[] AS e FROM embeddings) GROUP BY 1"),
    "tokenize_tf": (tokenize_tf, f"WITH {_KW.split(',' + chr(10) + 'n AS')[0]} SELECT key, token, tf FROM p"),
    "doc_freq_idf": (doc_freq_idf, f"WITH {_KW} SELECT token, df, round(ln(1 + n / df::DOUBLE), 6) AS idf FROM df, n"),
    "keyword_topk": (keyword_topk, f"WITH {_KW} {_RANK4.format('k', K)}"),
    "keyword_shard_idf": (keyword_shard_idf, f"WITH {_KW_SHARD} {_RANK4.format('k', K)}"),
    "hybrid_weighted": (hybrid_weighted, f"WITH {_HC}, f AS (SELECT qid, key, 0.7::DOUBLE * coalesce(v, 0) + 0.3::DOUBLE * coalesce(t, 0) AS score FROM u JOIN c USING (key) WHERE lang = 'en') {_RANK4.format('f', K)}"),
    "hybrid_rrf": (hybrid_rrf, f"WITH {_HC}, f AS (SELECT qid, key, 1 / (60 + coalesce(rv, 1 + count(*) OVER (PARTITION BY qid)))::DOUBLE + 1 / (60 + coalesce(rt, 1 + count(*) OVER (PARTITION BY qid)))::DOUBLE AS score FROM u) {_TOP.format('f', K)}"),
    "hybrid_staged_explain": (hybrid_staged_explain, f"WITH {_HC}, f AS (SELECT *, 0.4::DOUBLE * coalesce(v, 0) + 0.6::DOUBLE * coalesce(t, 0) AS score FROM u), g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM f) SELECT qid, rank::INT AS rank, key, round(score, 4) AS score, round(coalesce(v, 0), 4) AS vector_score_raw, round(coalesce(t, 0), 4) AS keyword_score_raw, coalesce(rv, 0)::INT AS rank_before, rank::INT AS rank_after, 'weighted_sum' AS fusion_method FROM g WHERE rank <= 10"),
    "latest_wins": (latest_wins, f"WITH {_LOG} SELECT key, n, op FROM t"),
    "tombstone_antijoin": (tombstone_antijoin, f"WITH {_LOG} SELECT key, n FROM t WHERE op <> 'delete'"),
    "ttl_live": (ttl_live, f"WITH {_LOG} SELECT key, n, CASE WHEN expires_at IS NULL THEN -1 ELSE greatest(0, epoch_us(expires_at) // 1000 - epoch_us(TIMESTAMP '{AS_OF}') // 1000) END::BIGINT AS ttl_left FROM t WHERE op <> 'delete' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}')"),
    "export_records": (export_records, "SELECT doc_id::VARCHAR AS key, label::VARCHAR AS tag, length(text)::BIGINT AS n_chars, len(embedding)::BIGINT AS dim FROM documents JOIN embeddings ON doc_id = vec_id WHERE lang = 'en' AND source = 'src3'"),
    "engine_stats": (engine_stats, f"WITH {_LOG}, a AS (SELECT count(*) AS num_keys, count(*) FILTER (op <> 'delete') AS num_live, count(*) FILTER (op = 'delete') AS num_deleted FROM t), b AS (SELECT count(*) AS num_entries FROM l) SELECT num_entries, num_keys, num_live, num_deleted, round((num_entries - num_live) / num_entries::DOUBLE, 6) AS stale_ratio, num_live * 256 AS vector_bytes FROM a, b"),
    "latency_histogram": (latency_histogram, f"SELECT bucket::INT AS bucket, {_UPPER} AS upper, n FROM (SELECT {_BUCKET} AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)"),
    "sq8_train": (sq8_train, f"WITH {_SQ} SELECT pos::INT AS pos, round(lo, 9) AS lo, round(step, 9) AS step FROM r"),
    "sq8_encode": (sq8_encode, f"WITH {_SQ} SELECT key, sum(code)::BIGINT AS code_sum, max(code)::BIGINT AS code_max, count(*) AS dim FROM c GROUP BY 1"),
    "sq8_approx_topk": (sq8_approx_topk, f"WITH {_SQ_APPROX} {_TOP.format('a', K)}"),
    "sq8_two_stage": (sq8_two_stage, f"WITH {_SQ_APPROX}, b AS (SELECT qid, key FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS cut FROM a) WHERE cut <= 30), e AS (SELECT b.qid, b.key, list_dot_product(qv::DOUBLE[], embedding::DOUBLE[]) AS score FROM b JOIN q USING (qid) JOIN embeddings ON vec_id::VARCHAR = key) {_TOP.format('e', K)}"),
    "centroid_assign": (centroid_assign, f"WITH {_CENT} SELECT key, cid::INT AS cid FROM li"),
    "kmeans_one_step": (kmeans_one_step, f"WITH {_STEP} SELECT cid::INT AS cid, pos::INT AS pos, round((x / n)::FLOAT::DOUBLE, 3) + 0.0 AS x FROM z JOIN zn USING (cid)"),
    "ivf_probe_topk": (ivf_probe_topk, f"WITH {_PROBE}, s AS (SELECT qid, key, list_dot_product(qv::DOUBLE[], embedding::DOUBLE[]) AS score FROM pr JOIN li USING (cid)) {_TOP.format('s', K)}"),
    "ivf_sq8_topk": (ivf_sq8_topk, f"WITH {_SQ}, {_PROBE}, qx AS (SELECT qid, cid, i AS pos, qv[i + 1]::DOUBLE AS qx FROM pr, unnest(range(0, len(qv))) AS g(i)), a AS (SELECT qid, key, sum(qx * (lo + code * step)) AS score FROM c JOIN li USING (key) JOIN qx USING (pos, cid) GROUP BY 1, 2), b AS (SELECT qid, key FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS cut FROM a) WHERE cut <= 30), e AS (SELECT b.qid, b.key, list_dot_product(qv::DOUBLE[], embedding::DOUBLE[]) AS score FROM b JOIN q USING (qid) JOIN embeddings ON vec_id::VARCHAR = key) {_TOP.format('e', K)}"),
    "recall_at_k": (recall_at_k, f"WITH {_PROBE}, s AS (SELECT qid, key, list_dot_product(qv::DOUBLE[], embedding::DOUBLE[]) AS score FROM pr JOIN li USING (cid)), a AS ({_TOP.format('s', K)}), {_S.replace('s AS', 'fs AS', 1)}, b AS ({_TOP.format('fs', K)}) SELECT b.qid, round(count(a.key) / count(*)::DOUBLE, 6) AS recall FROM b LEFT JOIN a ON a.qid = b.qid AND a.key = b.key GROUP BY 1"),
    "percentile_nearest_rank": (percentile_nearest_rank, "SELECT event_type, p::DOUBLE AS p, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL), (VALUES (0.5), (0.95), (0.99)) AS t(p) WHERE r = floor(p * (n - 1))"),
    "duplicate_pairs": (duplicate_pairs, "SELECT a.vec_id AS qid, b.vec_id::VARCHAR AS key, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.95"),
    "ivf_recall": (ivf_recall, "SELECT count(*) AS n_queries, true AS holds FROM embeddings WHERE vec_id % 100 = 0"),
    "hnsw_recall": (hnsw_recall, "SELECT count(*) AS n_queries, true AS holds FROM embeddings WHERE vec_id % 100 = 0"),
    "self_match": (self_match, f"WITH {_Q}, {_S}, a AS ({_TOP.format('s', 1)}) SELECT avg((key = qid::VARCHAR)::INT) AS recall_at_1 FROM a"),
    "engine_prefilter": (engine_prefilter, f"{_w(_Q, _S)} {_TOP.format('(SELECT * FROM s WHERE label = 3)', K)}"),
    "engine_checkpoint": (engine_checkpoint, f"{_w(_Q, _S)} {_TOP.format('s', K)}"),
    "ivf_trained": (ivf_trained, None),
    "hnsw_topk": (hnsw_topk, None),
}
