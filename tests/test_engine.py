from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest

from quillon.config import AlreadyExists, EngineConfig, InvalidArgument, NotFound, QueryPolicy, ResourceExhausted, Unavailable, candidate_bound, resolve_topk
from quillon.engine import SearchEngine
from quillon.functions import hashing
from quillon.functions import vectors as V
from quillon.functions.text import tokenize
from quillon.operators import evaluate, fusion, hnsw, ivf, keyword, kmeans, mutations, quantize
from quillon.sources import checkpoint, documents
from quillon.streaming import ingest
from pyspark.sql import functions as F


def keys(df):
    return [r["key"] for r in df.orderBy("rank").collect()]


def engine(spark, rows, **cfg):
    e = SearchEngine(spark, EngineConfig(**cfg))
    e.upsert(rows)
    return e


GOLDEN = [
    {"key": "doc-a", "vector": [1, 0], "meta": {"tag": "alpha"}, "text": "alpha"},
    {"key": "doc-b", "vector": [0, 1], "meta": {"tag": "beta"}, "text": "beta"},
    {"key": "doc-c", "vector": [0.5, 0.5], "meta": {"tag": "alpha"}, "text": "alpha beta"},
    {"key": "doc-d", "vector": [0.2, 0.8], "meta": {"tag": "alpha"}, "text": "gamma alpha"},
]


def test_golden_contract(spark):
    e = engine(spark, GOLDEN, dim=2)
    got = e.search([[1, 0]], 3).orderBy("rank").collect()
    assert [(r["key"], round(r["score"], 4)) for r in got] == [("doc-a", 1.0), ("doc-c", 0.5), ("doc-d", 0.2)]
    got = e.search_hybrid_with_explain([1, 0], "alpha", 3, 0.5).orderBy("rank").collect()
    want = {"doc-a": 0.92364893, "doc-c": 0.67364893, "doc-d": 0.52364893}
    assert [r["key"] for r in got] == list(want)
    assert all(abs(r["score"] - want[r["key"]]) < 1e-4 for r in got)
    assert {r["query_id"] for r in got} == {r["query_id"] for r in e.search_hybrid_with_explain([1, 0], "alpha", 3, 0.5).collect()}


def test_search_rules(spark):
    rows = [*GOLDEN, {"key": "nan", "vector": [float("nan"), 0]}, {"key": "zero", "vector": [0, 0]}, {"key": "tie", "vector": [1, 0]}]
    e = engine(spark, rows, dim=2)
    assert keys(e.search([[1, 0]]))[:2] == ["doc-a", "tie"]
    assert keys(e.search([[1, 0]]))[-1] == "nan"
    assert keys(e.search([[1, 0]], 2, {"tag": "alpha"}, filter_mode="pre")) == ["doc-a", "doc-c"]
    assert keys(e.search([[1, 0]], 2, {"tag": "none"})) == []
    assert keys(e.search_by_key("doc-b", 1)) == ["doc-b"]
    with pytest.raises(InvalidArgument):
        e.search([[1, 0, 0]])
    with pytest.raises(InvalidArgument):
        e.search([[1, 0]], filters={"colour": "red"})
    with pytest.raises(NotFound):
        e.search_by_key("nobody")


def test_cosine_normalises(spark):
    e = engine(spark, [{"key": "a", "vector": [3, 4]}, {"key": "z", "vector": [0, 0]}], dim=2, similarity="cosine")
    assert [round(x, 6) for x in e.get_vector("a")] == [0.6, 0.8]
    got = {r["key"]: r["score"] for r in e.search([[6, 8]]).collect()}
    assert abs(got["a"] - 1) < 1e-6 and got["z"] == 0


def test_mutations(spark):
    t0 = datetime(2024, 1, 1)
    e = engine(spark, GOLDEN, dim=2)
    e.upsert([{"key": "doc-a", "vector": [0, 2], "ttl_ms": 1000}], written=t0)
    assert e.live(t0 + timedelta(milliseconds=999)).count() == 4
    assert e.live(t0 + timedelta(milliseconds=1000)).count() == 3  # inclusive
    e.delete(["doc-b"])
    e.delete(["doc-b"])
    assert not e.exists("doc-b") and e.exists("doc-a")
    with pytest.raises(NotFound):
        e.exists("nobody")
    with pytest.raises(NotFound):
        e.delete(["nobody"])
    s = e.stats()
    assert (s["num_keys"], s["num_live"], s["num_deleted"]) == (4, 3, 1)
    assert [r["ttl_ms"] for r in e.export_records(as_of=t0).where("key = 'doc-a'").collect()] == [1000]
    e.compact()
    assert e.stats()["num_entries"] == 3 and len(list(e.iterate())) == 3
    assert '"deletes": 2' in e.metrics_json()
    e.close()
    with pytest.raises(Unavailable):
        e.search([[1, 0]])


def test_capacity(spark):
    e = engine(spark, GOLDEN[:2], dim=2, max_points_per_shard=2)
    e.upsert([{"key": "doc-a", "vector": [1, 1]}])
    with pytest.raises(ResourceExhausted):
        e.upsert([{"key": "new", "vector": [1, 1]}])
    with pytest.raises(InvalidArgument):
        e.upsert([{"key": "doc-a", "vector": [1]}])


def test_hybrid(spark):
    rows = [{"key": "a", "vector": [1, 0], "text": "orange"}, {"key": "b", "vector": [0.9, 0.1], "text": "orange juice"}]
    e = engine(spark, rows, dim=2)
    assert keys(e.search_hybrid([1, 0], "orange", 2, 0.7))[0] == "a"
    assert keys(e.search_hybrid(None, "juice", 2)) == ["b"]
    assert keys(e.search_hybrid([1, 0], "", 2)) == ["a", "b"]
    assert keys(e.search_hybrid(None, "", 2)) == []
    low = e.search_hybrid_with_explain([1, 0], "juice", 2, 0.2).where("key = 'b'").first()["score"]
    high = e.search_hybrid_with_explain([1, 0], "juice", 2, 0.8).where("key = 'b'").first()["score"]
    assert abs(low - high) > 1e-3
    rrf = e.search_hybrid_with_explain([1, 0], "juice", 2, policy=QueryPolicy(fusion_method="rrf")).orderBy("rank").collect()
    assert rrf[0]["key"] == "b" and abs(rrf[0]["score"] - (1 / 62 + 1 / 61)) < 1e-12
    with pytest.raises(InvalidArgument):
        e.search_hybrid_with_explain([1, 0], "x", 2, policy=QueryPolicy(fusion_method="other"))


def test_sharding_returns_all(spark):
    rows = [{"key": f"k{i}", "vector": [1, 0], "text": f"banana {i}"} for i in range(40)]
    e = engine(spark, rows, dim=2, num_shards=4)
    assert len(set(keys(e.search([[1, 0]], 50)))) == 40
    assert len(keys(e.search_hybrid(None, "banana", 100))) == 40


def test_keyword_edges(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", None), ("c", "..."), ("d", "x x")], "key string, text string")
    q = spark.createDataFrame([(0, "x x nothere")], "qid int, text string")
    got = {r["key"]: r["score"] for r in keyword.search(docs, q, 10).collect()}
    assert set(got) == {"a", "d"} and abs(got["d"] - 4 * np.log(2)) < 1e-6
    assert spark.range(1).select(tokenize(F.lit("Ab-c é9 ")).alias("t")).first()[0] == ["ab", "c", "9"]


def test_hash_vectors(spark):
    df = spark.createDataFrame([("alpha",), ("key123",), ("",)], "k string").select("k", hashing.fnv_hex(F.col("k")).alias("h"), hashing.shard_of(F.col("k"), 7).alias("s"))
    for k, h, s in df.collect():
        assert int(h, 16) == hashing.fnv1a64(k.encode()) and s == int(h, 16) % 7
    assert f"{hashing.fnv1a64(b'alpha'):016x}" == "8ac625bb85ed202b"


def test_vector_functions(spark):
    row = spark.range(1).select(V.dot(F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0))), F.array(*map(F.lit, (5.0, 6.0, 7.0, 8.0)))).alias("d"), V.l2_squared(F.array(F.lit(1.0)), F.array(F.lit(4.0))).alias("l"), V.parse_vector(F.lit("1, 2.5")).alias("v"), V.parse_pairs(F.lit("a=1,b=2")).alias("m"), V.sanitize(F.lit(float("nan"))).alias("n")).first()
    assert (row["d"], row["l"], list(row["v"]), row["m"], row["n"]) == (70.0, 9.0, [1.0, 2.5], {"a": "1", "b": "2"}, float("-inf"))
    assert candidate_bound(10, EngineConfig(dim=1)) == (10, 40) and resolve_topk(-1, EngineConfig(dim=1)) == 10
    assert fusion.stage_budget(10, 5) == 10 and fusion.stage_budget(10) == 20


def unit(n, dim, seed):
    v = np.random.default_rng(seed).normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def table(spark, v):
    return spark.createDataFrame([(f"{i}", x.tolist()) for i, x in enumerate(v)], "key string, vector array<float>").repartition(4).cache()


def queries(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "qid int, qv array<float>")


def truth(v, q, k):
    s = q @ v.T
    return {i: {str(j) for j in np.argsort(-s[i], kind="stable")[:k]} for i in range(len(q))}


def recall(df, want):
    got = {}
    for r in df.collect():
        got.setdefault(r["qid"], set()).add(r["key"])
    return np.mean([len(got.get(i, set()) & w) / len(w) for i, w in want.items()])


def test_hnsw_recall(spark):
    v = np.random.default_rng(1).random((1000, 16))
    q = np.random.default_rng(2).random((30, 16))
    t = table(spark, v)
    edges = hnsw.build(t, 2, 16, 100).cache()
    assert recall(hnsw.search(t, edges, queries(spark, q), 2, 10, None, 50), truth(v, q, 10)) > 0.95
    assert recall(hnsw.search(t, edges, queries(spark, q[:3]), 2, 10, None, 2000), truth(v, q[:3], 10)) == 1


def test_ivf_and_sq8(spark):
    v = unit(600, 16, 3)
    t, q = table(spark, v), queries(spark, v[:20])
    lists, centroids = ivf.build(t, 4, 5)
    want = truth(v, v[:20], 10)
    assert recall(ivf.search(lists, q, centroids, 4, 10), want) == 1
    assert recall(ivf.search(lists, q, centroids, 1, 10), want) > 0.4
    trained = quantize.train(t)
    coded = quantize.with_codes(lists, trained)
    res = ivf.search_sq8(coded, q, centroids, trained, 4, 10)
    assert recall(res, want) > 0.97
    assert evaluate.self_recall(res).first()[0] > 0.94
    assert ivf.stats(lists).agg(F.sum("n")).first()[0] == 600
    with pytest.raises(InvalidArgument):
        kmeans.initial(t.limit(2), 3)


def test_sq8_two_stage_sorts_no_pairs(spark):
    v = unit(300, 8, 7)
    v[100:200] = v[100]  # equal scores: by key
    t, q = table(spark, v), queries(spark, v[[5, 100, 250]])
    trained = quantize.train(t)
    coded = quantize.with_codes(t, trained)
    made = quantize.two_stage(coded, q, trained, 4)
    assert "vector" not in quantize.best(coded, q, trained, 12).columns
    lo, step = (np.array([r[c] for r in trained.orderBy("pos").collect()]) for c in ("lo", "step"))
    w = np.array(v, np.float32).astype(np.float64)
    decoded = np.floor(np.clip((w - lo) / step, 0, 255) + 0.5) * step + lo
    dot = lambda a, b: np.cumsum(a * b, 1)[:, -1]
    got = {(r["qid"], r["rank"]): (r["key"], r["score"]) for r in made.collect()}
    for i, n in enumerate((5, 100, 250)):
        a, s = dot(decoded, w[[n]]), dot(w, w[[n]])
        near = sorted(range(300), key=lambda j: (-a[j], str(j)))[:12]
        want = sorted(near, key=lambda j: (-s[j], str(j)))[:4]
        assert [got[i, k + 1] for k in range(4)] == [(str(j), s[j]) for j in want]


def test_engine_indexes(spark):
    v = unit(420, 8, 4)
    rows = [{"key": str(i), "vector": x.tolist()} for i, x in enumerate(v)]
    for index in ("hnsw", "ivf_flat", "ivf_sq8"):
        e = engine(spark, rows, dim=8, index=index, ivf_nlist=4, ivf_nprobe=4)
        e.build_index()
        assert e._index is not None
        assert keys(e.search([v[7].tolist()], 3))[0] == "7"


def test_checkpoint(spark, tmp_path):
    e = engine(spark, GOLDEN, dim=2, ivf_nlist=7)
    at = f"file://{tmp_path}/cp"
    e.save(at)
    with pytest.raises(AlreadyExists):
        e.save(at)
    back = SearchEngine.load(spark, at)
    assert back.cfg == e.cfg and keys(back.search([[1, 0]], 3)) == ["doc-a", "doc-c", "doc-d"]
    with pytest.raises(NotFound):
        checkpoint.read(spark, f"file://{tmp_path}/none")
    part = next(p for p in (tmp_path / "cp/records").glob("*.parquet") if p.stat().st_size > 1500)
    raw = bytearray(part.read_bytes())
    raw[len(raw) // 3] ^= 0xFF
    part.write_bytes(bytes(raw))
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(InvalidArgument):
        checkpoint.read(spark, at)


def test_contract_files(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"config": {"dim": 2, "num_shards": 1, "index_type": "flat", "global_seed": 1, "contract_version": 3}, "records": [{"key": "a", "vector": [1, 0], "metadata": {"tag": "x"}, "text": "red"}, {"key": "b", "vector": [0, 1], "text": "blue"}]}')
    (tmp_path / "q.json").write_text('{"queries": [{"vector": [1, 0], "topk": 2}, {"vector": [1, 0], "text_query": "blue", "topk": 2, "alpha": 0.5, "policy": {"fusion_method": "weighted_sum"}}]}')
    from quillon.cli import run_contract

    found = run_contract(spark, f"{tmp_path}/d.json", f"{tmp_path}/q.json").cache()
    documents.write_expected(found, f"{tmp_path}/e")
    assert documents.differences(found, documents.read_expected(spark, f"{tmp_path}/e")).count() == 0
    assert documents.differences(found.withColumn("score", F.col("score") + 1), documents.read_expected(spark, f"{tmp_path}/e")).count() == found.count()
    documents.write_jsonl(found, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == found.count()


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "upsert", "a"), (2, "delete", "a"), (3, "upsert", "b")], "seq long, op string, key string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("seq long, op string, key string").parquet(f"{tmp_path}/in")
    ingest.append_log(stream, f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination()
    assert [r["key"] for r in ingest.live_view(spark.read.parquet(f"{tmp_path}/log"), ["seq"]).collect()] == ["b"]


def test_maintenance():
    assert mutations.needs_compaction(0.4, 1, 1) and mutations.needs_compaction(0, 50_001, 1) and not mutations.needs_compaction(0.3, 10, 10)


def test_entry_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['quillon.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'flat_topk_dot' in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[1])


def test_rows_of_one_batch(spark):
    engine = SearchEngine(spark, EngineConfig(dim=2))
    engine.upsert([{"key": "k", "vector": [1, 0]}, {"key": "k", "vector": [0, 1]}])
    assert engine.get_vector("k") == [0.0, 1.0]
    twice = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0])], "key string, vector array<float>")
    with pytest.raises(InvalidArgument):
        engine.upsert(twice)
    for vector in (None, [1.0], [1.0, None]):
        with pytest.raises(InvalidArgument):
            engine.upsert(spark.createDataFrame([("b", vector)], "key string, vector array<float>"))
    with pytest.raises(InvalidArgument):
        engine.upsert([{"key": "t", "vector": [1, 0], "ttl_ms": 5}])


def test_exists_after_expiry_and_compaction(spark):
    engine = SearchEngine(spark, EngineConfig(dim=2))
    began = datetime(2024, 1, 1)
    engine.upsert([{"key": "t", "vector": [1, 0], "ttl_ms": 1000}, {"key": "d", "vector": [0, 1]}], written=began)
    engine.delete(["d"])
    later = began + timedelta(seconds=2)
    assert engine.exists("t") and engine.exists("t", began) and not engine.exists("t", later)
    engine.compact(later)
    assert not engine.exists("t") and not engine.exists("d") and engine.live().count() == 0
    with pytest.raises(NotFound):
        engine.exists("never")


def test_save_over_the_loaded_checkpoint(spark, tmp_path):
    path = f"file://{tmp_path}/own"
    engine = SearchEngine(spark, EngineConfig(dim=2))
    engine.upsert([{"key": "a", "vector": [1, 0]}])
    engine.save(path)
    again = SearchEngine.load(spark, path)
    again.upsert([{"key": "b", "vector": [0, 1]}])
    again.save(path, overwrite=True)
    assert [r["key"] for r in again.search([[0, 1]], topk=2).orderBy("rank").collect()] == ["b", "a"]
    assert SearchEngine.load(spark, path).live().count() == 2


def test_saved_index(spark, tmp_path):
    v = unit(420, 8, 4)
    rows = [{"key": str(i), "vector": x.tolist()} for i, x in enumerate(v)]
    for index in ("hnsw", "ivf_flat", "ivf_sq8"):
        e = engine(spark, rows, dim=8, index=index, ivf_nlist=4, ivf_nprobe=4)
        e.build_index()
        path = f"file://{tmp_path}/{index}"
        assert set(e.save(path)["tables"]) == {"records", *e._index}
        back = SearchEngine.load(spark, path, e.cfg)
        assert back.index_stats() == e.index_stats() and back.index_stats()["built"]
        assert keys(back.search([v[9].tolist()], 5)) == keys(e.search([v[9].tolist()], 5))
        back.save(path, overwrite=True)  # the index reads from the folder that is replaced
        assert keys(SearchEngine.load(spark, path).search([v[9].tolist()], 3))[0] == "9"
        with pytest.raises(InvalidArgument):
            SearchEngine.load(spark, path, EngineConfig(**{**e.cfg.as_dict(), "ivf_nlist": 5}))
        back.upsert([{"key": "new", "vector": [0.0] * 8}])
        assert not back.index_stats()["built"]


def test_stored_lists_are_pruned(spark, tmp_path):
    v = unit(400, 8, 6)
    lists, centroids = ivf.build(table(spark, v), 4, 3)
    stored = ivf.store(lists, f"file://{tmp_path}/lists")
    q = queries(spark, v[:1])
    one = ivf.candidates(stored, q, centroids, 1, True)
    assert "PartitionFilters: [cid" in one._jdf.queryExecution().executedPlan().toString()
    for nprobe in (1, 2, 4):
        a, b = ivf.search(stored, q, centroids, nprobe, 10, True), ivf.search(lists, q, centroids, nprobe, 10)
        assert a.orderBy("rank").collect() == b.orderBy("rank").collect()


def test_lists_know_expiry_and_filters(spark):
    v = unit(420, 8, 4)
    rows = [{"key": str(i), "vector": x.tolist(), "meta": {"tag": str(i % 50)}, "ttl_ms": 1000 if i == 7 else -1} for i, x in enumerate(v)]
    e = SearchEngine(spark, EngineConfig(dim=8, index="ivf_flat", ivf_nlist=4, ivf_nprobe=4))
    e.upsert(rows, datetime(2024, 1, 1))
    e.build_index()
    assert keys(e.search([v[7].tolist()], 1)) == ["7"]
    assert keys(e.search([v[7].tolist()], 1, as_of=datetime(2024, 1, 2))) != ["7"]
    assert len(keys(e.search([v[7].tolist()], 8, {"tag": "7"}, filter_mode="pre"))) == 8


def test_assignment_of_odd_vectors(spark):
    nan = float("nan")
    centroids = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "cid int, centroid array<float>")
    t = spark.createDataFrame([("tie", [1.0, 1.0]), ("left", [2.0, 0.0]), ("nan", [nan, nan]), ("null", None), ("left", [2.0, 0.0])], "key string, vector array<float>")
    got = sorted((r["key"], r["cid"]) for r in kmeans.assign(t, centroids).collect())
    assert got == [("left", 1), ("left", 1), ("nan", -1), ("null", -1), ("tie", 1)]
    moved = {r["cid"]: list(r["centroid"]) for r in kmeans.step(t, centroids).collect()}
    assert moved[3] == [1.0, 0.0] and moved[2] == [0.0, 1.0]  # empty clusters stay
    assert np.allclose(moved[1], np.array([5 / 3, 1 / 3]) / np.hypot(5 / 3, 1 / 3), atol=1e-6)
    assert kmeans.assign(t.limit(0), centroids).count() == 0 and kmeans.step(t.limit(0), centroids).count() == 3


def test_graphs_refuse_large_shards(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "MOST", 10)
    with pytest.raises(ResourceExhausted):
        hnsw.build(table(spark, unit(30, 4, 1)), 2)


def test_graphs_grow_in_number(spark, monkeypatch):
    assert hnsw.shards(table(spark, unit(30, 4, 1)), 2) == 2
    monkeypatch.setattr(hnsw, "PER_GRAPH", 10)
    monkeypatch.setattr(hnsw, "QUERIES", 7)  # several passes
    v = unit(95, 8, 5)
    t = table(spark, v)
    n = hnsw.shards(t, 2)
    assert n == 10
    edges = hnsw.build(t, n, 4, 20).cache()
    assert edges.select("shard").distinct().count() == 10
    found = hnsw.search(t, edges, queries(spark, v[:20]), n, 10, 10, 20)
    assert recall(found, truth(v, v[:20], 10)) == 1


def test_maintain(spark):
    e = engine(spark, [{"key": str(i), "vector": [1.0, float(i)]} for i in range(20)], dim=2)
    assert not e.maintain()
    e.delete([str(i) for i in range(15)])
    assert e.maintain() and e.stats()["num_entries"] == 5 and not e.maintain()
