"""The engine: a table of vectors with metadata and text, searched by vector, key, words or a mix of them.

State is a mutation log, kept as DataFrames: an upsert or delete appends a batch, reads see the latest entry of each key.
``compact`` rewrites the log to its live view in the shared checkpoint folder. Time is an argument (``as_of``), never the
wall clock, so results are repeatable.
"""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig, InvalidArgument, NotFound, QueryPolicy, Unavailable, candidate_bound, resolve_topk
from .functions import vectors as V
from .functions.hashing import query_id, shard_of, snapshot_id
from .operators import filters as P
from .operators import flat, fusion, hnsw, ivf, keyword, mutations, quantize
from .operators.topk import top
from .sources import checkpoint
from .sources.shared import shared_folder

RECORDS = "key string, vector array<float>, meta map<string,string>, text string, expires_at timestamp"
LOG = f"seq bigint, op string, {RECORDS}"


class SearchEngine:
    """Open with ``SearchEngine(spark, EngineConfig(dim=...))`` or from a checkpoint with ``load``."""

    def __init__(self, spark: SparkSession, cfg: EngineConfig):
        self.spark, self.cfg = spark, cfg.checked()
        self._log = spark.createDataFrame([], LOG)
        self._seq, self._open, self._index = 0, True, None
        self._past: DataFrame | None = None  # keys seen before the last compaction
        self._source: str | None = None  # the checkpoint that the log reads from
        self.counters = {"upserts": 0, "deletes": 0, "queries": 0}
        self.latencies_ms: list[float] = []

    # -- state

    def _check(self) -> None:
        if not self._open:
            raise Unavailable("the engine is closed")

    def close(self) -> None:
        self._open = False
        self._log = None

    @property
    def dim(self) -> int:
        return self.cfg.dim

    def live(self, as_of: datetime | None = None) -> DataFrame:
        """(key, vector, meta, text, expires_at) of keys that are neither deleted nor expired."""
        self._check()
        return mutations.live(self._log, ["seq"], as_of).select(*[x.split()[0] for x in RECORDS.split(", ")])

    def upsert(self, rows: DataFrame | list[dict], written: datetime | None = None) -> None:
        """rows: key, vector, and optionally meta, text, and ttl_ms (from written, which a ttl needs) or expires_at. Replaces whole records.

        A list may name a key twice: its last row wins. A DataFrame has no order, so there a repeated key is refused.
        """
        self._check()
        if isinstance(rows, DataFrame) and (twice := rows.groupBy("key").count().where("count > 1").first()) is not None:
            raise InvalidArgument(f"key {twice[0]} stands {twice[1]} times in one batch")
        if isinstance(rows, list):
            rows = list({r["key"]: r for r in rows}.values())  # of one batch the last row of a key wins
            rows = self.spark.createDataFrame([(r["key"], [float(x) for x in r["vector"]], r.get("meta") or {}, r.get("text") or "", r.get("ttl_ms", -1)) for r in rows], "key string, vector array<float>, meta map<string,string>, text string, ttl_ms long")
        have = set(rows.columns)
        if "ttl_ms" in have and "expires_at" not in have:
            if written is None and not rows.where("ttl_ms >= 0").isEmpty():
                raise InvalidArgument("ttl_ms needs the time that the rows were written")
            rows = mutations.with_expiry(rows.withColumn("_w", F.lit(written).cast("timestamp")), "_w", "ttl_ms")
        add = {c: F.lit(None).cast(k) for c, k in (("meta", "map<string,string>"), ("text", "string"), ("expires_at", "timestamp")) if c not in rows.columns}
        elements = F.coalesce(F.size("vector"), F.lit(-1))
        bad = rows.where(F.col("key").isNull() | F.col("vector").isNull() | (elements != self.cfg.dim) | F.exists("vector", lambda x: x.isNull())).select("key", elements).first()
        if bad is not None:
            raise InvalidArgument(f"key {bad[0]}: a key and a vector of {self.cfg.dim} elements without nulls are needed; it has {bad[1]} elements")
        vector = V.normalize(F.col("vector")) if self.cfg.similarity == "cosine" else F.col("vector")
        rows = rows.withColumns(add).withColumn("vector", vector)
        mutations.check_capacity(self.live(), rows, self.cfg.num_shards, self.cfg.max_points_per_shard)
        self._append(rows.withColumn("op", F.lit("upsert")))
        self.counters["upserts"] += 1

    def delete(self, keys: list[str] | DataFrame) -> None:
        """Tombstones; a key that was never seen raises NotFound. Deleting twice changes nothing."""
        self._check()
        if isinstance(keys, list):
            keys = self.spark.createDataFrame([(k,) for k in keys], "key string")
        unseen = keys.join(self._seen(), "key", "left_anti").first()
        if unseen is not None:
            raise NotFound(unseen[0])
        null = {n: F.lit(None).cast(k) for n, k in (x.split() for x in RECORDS.split(", ")[1:])}
        self._append(keys.select("key").withColumns(null).withColumn("op", F.lit("delete")))
        self.counters["deletes"] += 1

    def _append(self, rows: DataFrame) -> None:
        self._seq += 1
        names = [x.split()[0] for x in LOG.split(", ")]
        self._log = self._log.unionByName(rows.withColumn("seq", F.lit(self._seq).cast("long")).select(*names))
        self._index = None

    def compact(self, as_of: datetime | None = None) -> None:
        """Rewrites the log to its live view: cuts lineage, drops tombstones and expired rows. Keys once seen stay known."""
        base = f"{shared_folder(self.spark)}/log-{uuid.uuid4().hex}"
        names = [x.split()[0] for x in LOG.split(", ")]
        self._seen().write.parquet(f"{base}/seen")
        self.live(as_of).withColumn("op", F.lit("upsert")).withColumn("seq", F.lit(0).cast("long")).select(*names).write.parquet(f"{base}/log")
        self._log = self.spark.read.schema(LOG).parquet(f"{base}/log")
        self._past = self.spark.read.schema("key string").parquet(f"{base}/seen")
        if as_of is not None:
            self._index = None  # it may hold rows that are gone
        self._source = None

    def _seen(self) -> DataFrame:
        """(key): every key that was ever written."""
        keys = self._log.select("key")
        return (keys if self._past is None else keys.union(self._past)).distinct()

    def exists(self, key: str, as_of: datetime | None = None) -> bool:
        self._check()
        found = mutations.exists(self._log, key, as_of)
        if found is None and self._seen().where(F.col("key") == key).isEmpty():
            raise NotFound(key)
        return bool(found)

    def get_vector(self, key: str, as_of: datetime | None = None) -> list[float]:
        row = self.live(as_of).where(F.col("key") == key).select("vector").first()
        if row is None:
            raise NotFound(key)
        return list(row[0])

    # -- search

    def _queries(self, queries: DataFrame | list[list[float]]) -> DataFrame:
        if isinstance(queries, list):
            for q in queries:
                if len(q) != self.cfg.dim:
                    raise InvalidArgument(f"a query has {len(q)} elements, not {self.cfg.dim}")
            queries = self.spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(queries)], "qid int, qv array<float>")
        qv = V.checked_dim(F.col("qv"), self.cfg.dim)
        return queries.withColumn("qv", V.normalize(qv) if self.cfg.similarity == "cosine" else qv)

    def build_index(self) -> None:
        """Builds the configured index over the live rows and stores it in the shared folder; searches use it until the next mutation."""
        table, c = self.live(), self.cfg
        if c.index == "hnsw":
            self._index = self._kept({"edges": hnsw.build(table, c.num_shards, c.hnsw_m, c.hnsw_ef_construction, c.hnsw_seed)})
        elif c.index in ("ivf_flat", "ivf_sq8") and table.count() >= ivf.train_threshold(c.ivf_nlist):
            lists, centroids = ivf.build(table, c.ivf_nlist)
            parts = {"centroids": centroids}
            if c.index == "ivf_sq8":
                parts["trained"] = quantize.train(table)
                lists = quantize.with_codes(lists, parts["trained"])
            self._index = self._kept({"lists": lists, **parts})

    def _kept(self, parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The tables of an index, written to the shared folder and read from there."""
        base = f"{shared_folder(self.spark)}/index-{uuid.uuid4().hex}"
        out = {}
        for name, df in parts.items():
            if name == "lists":
                out[name] = ivf.store(df, f"{base}/{name}")
            else:
                df.write.parquet(f"{base}/{name}")
                out[name] = self.spark.read.schema(df.schema).parquet(f"{base}/{name}")
        return out

    def index_stats(self) -> dict:
        """Of the index: family, points seen, deleted ones among them, lists (or shards) and rows or edges stored."""
        s = self.stats()
        out = {"family": self.cfg.index, "built": self._index is not None, "points": s["num_keys"], "deleted": s["num_deleted"]}
        if self._index is None:
            return {**out, "groups": 0, "stored": 0}
        of, by = ("edges", "shard") if "edges" in self._index else ("lists", "cid")
        groups, stored = self._index[of].agg(F.count_distinct(by), F.sum(F.size("neighbours")) if of == "edges" else F.count(F.lit(1))).first()
        return {**out, "groups": groups, "stored": stored}

    def maintain(self, as_of: datetime | None = None) -> bool:
        """Compacts the log and rebuilds lists and codes if the share of stale entries or the log's size asks for it."""
        s = self.stats()
        if not mutations.needs_compaction(s["stale_ratio"], s["num_entries"], s["num_entries"] * 4 * self.cfg.dim):
            return False
        self.compact(as_of)
        self.build_index()
        return True

    def _candidates(self, table: DataFrame, queries: DataFrame, bound: int, as_of: datetime | None, filters: dict[str, str] | None) -> DataFrame:
        """(qid, qv, key, vector, ...): what the index offers of rows unexpired by as_of, and of those that pass filters (before the cut).

        Without a built index, an exact scan of table, which holds such rows only.
        """
        c = self.cfg
        if self._index is None:
            return flat.route(table, queries, bound)
        if c.index == "hnsw":
            near = hnsw.route(self.live(), self._index["edges"], queries, c.num_shards, bound, c.hnsw_ef_search)
            return near.join(table.drop("vector"), "key")
        trained = self._index.get("trained")
        lists = P.live(self._index["lists"], as_of, filters)
        near = ivf.candidates(lists, queries, self._index["centroids"], c.ivf_nprobe, True)
        if trained is None:
            near = near.withColumn("approx", V.sanitize(V.dot(F.col("vector"), F.col("qv"))))
        else:
            near = near.crossJoin(F.broadcast(quantize.params(trained))).withColumn("approx", V.sanitize(V.dot(F.col("qv"), quantize.decode(F.col("code"), F.col("lo"), F.col("step")))))
        return top(near, bound if trained is None else quantize.REFINE * bound, ["qid"], "approx", "key", "_c").drop("_c")

    def _vector_side(self, queries: DataFrame, k: int, filters: dict[str, str] | None, as_of: datetime | None, mode: str) -> DataFrame:
        rows, bound = candidate_bound(k, self.cfg)
        early = filters if mode == "pre" else None
        near = self._candidates(P.live(self.live(as_of), None, early), queries, bound, as_of, early)
        if filters:
            near = near.where(P.metadata(filters))
        return flat.rerank(near, rows)

    def search(self, queries: DataFrame | list[list[float]], topk: int | None = None, filters: dict[str, str] | None = None, as_of: datetime | None = None, filter_mode: str = "post") -> DataFrame:
        """(qid, rank, key, score, meta). post: filters after the candidate cut, so fewer rows may return; pre: before it."""
        self._check()
        began = time.perf_counter()
        out = self._vector_side(self._queries(queries), resolve_topk(topk, self.cfg), filters, as_of, filter_mode)
        self._count(began)
        return out.select("qid", "rank", "key", "score", "meta")

    def _count(self, began: float) -> None:
        self.counters["queries"] += 1
        self.latencies_ms.append((time.perf_counter() - began) * 1000)

    def search_by_key(self, key: str, topk: int | None = None, filters: dict[str, str] | None = None) -> DataFrame:
        """Neighbours of a stored vector, itself included."""
        return self.search([self.get_vector(key)], topk, filters)

    def search_with_explain(self, queries: DataFrame | list[list[float]], topk: int | None = None, filters: dict[str, str] | None = None, policy: QueryPolicy | None = None) -> DataFrame:
        k = resolve_topk(topk, self.cfg)
        bound = max(k, min((policy or QueryPolicy()).max_candidates or 4 * k, 2000))
        out = self.search(queries, topk, filters)
        return out.withColumns({"stage": F.lit("canonical_search"), "fusion_method": F.lit("exact_rerank"), "rank_before": F.col("rank"), "rank_after": F.col("rank"), "candidate_bound": F.lit(bound), "snapshot_id": F.lit(self.snapshot_id())})

    def _keyword_side(self, queries: DataFrame, k: int, filters: dict[str, str] | None, as_of: datetime | None) -> DataFrame:
        """The best k by words, then filtered."""
        table = self.live(as_of)
        shard = None
        if self.cfg.num_shards > 1:
            table, shard = table.withColumn("shard", shard_of(F.col("key"), self.cfg.num_shards)), "shard"
        cut = top(keyword.scores(table, queries, shard), k, ["qid"]).drop("rank")
        return cut.join(table.where(P.metadata(filters)).select("key"), "key", "left_semi") if filters else cut

    def search_hybrid(self, vector: list[float] | None, text: str = "", topk: int | None = None, alpha: float = 0.5, filters: dict[str, str] | None = None, as_of: datetime | None = None) -> DataFrame:
        """Weighted sum of both sides' best 2k, filters last."""
        self._check()
        began = time.perf_counter()
        k = resolve_topk(topk, self.cfg)
        table = self.live(as_of)
        v, t = self._sides(vector, text, table, 2 * k, None, as_of)
        out = fusion.simple(v, t, k, alpha, table.where(P.metadata(filters)) if filters else None)
        self._count(began)
        return out.join(table.select("key", "meta"), "key").select("qid", "rank", "key", "score", "meta")

    def _sides(self, vector: list[float] | None, text: str, table: DataFrame, k: int, filters: dict[str, str] | None, as_of: datetime | None) -> tuple[DataFrame, DataFrame]:
        none = self.spark.createDataFrame([], "qid int, key string, score double")
        v = none if vector is None else self._vector_side(self._queries([vector]), k, filters, as_of, "post").select("qid", "key", "score")
        t = none if not text else self._keyword_side(self.spark.createDataFrame([(0, text)], "qid int, text string"), k, filters, as_of).select("qid", "key", "score")
        return v, t

    def search_hybrid_with_explain(self, vector: list[float] | None, text: str = "", topk: int | None = None, alpha: float = 0.5, policy: QueryPolicy | None = None, filters: dict[str, str] | None = None, as_of: datetime | None = None) -> DataFrame:
        """Staged fusion with each row's raw scores and ranks, the query's and the snapshot's ids."""
        self._check()
        began = time.perf_counter()
        policy = policy or QueryPolicy()
        if policy.fusion_method not in ("weighted_sum", "rrf"):
            raise InvalidArgument(f"unknown fusion method {policy.fusion_method!r}")
        k = resolve_topk(topk, self.cfg)
        v, t = self._sides(vector, text, self.live(as_of), fusion.stage_budget(k, policy.max_candidates), filters, as_of)
        out = fusion.staged(v, t, k, policy.fusion_method, alpha, policy.max_candidates)
        self._count(began)
        return out.withColumns({"query_id": F.lit(query_id(vector or [], text, k, filters or {})), "snapshot_id": F.lit(self.snapshot_id()), "vector_stage": F.lit("vector_stage_1"), "keyword_stage": F.lit("keyword_stage")})

    # -- reports

    def stats(self) -> dict:
        self._check()
        return mutations.stats(self._log, self.cfg.dim, ["seq"]).first().asDict()

    def memory_stats(self) -> dict:
        s = self.stats()
        return {"live_points": s["num_live"], "total_points": s["num_keys"], "vector_bytes": s["vector_bytes"]}

    def snapshot_id(self) -> str:
        s = self.stats()
        return snapshot_id(self.cfg.contract_version, self.cfg.global_seed, s["num_live"], s["num_deleted"])

    def metrics_json(self) -> str:
        bounds = mutations.LATENCY_BOUNDS
        buckets = [0] * (len(bounds) + 1)
        for ms in self.latencies_ms:
            buckets[next((i for i, b in enumerate(bounds) if ms <= b), len(bounds))] += 1
        return json.dumps({**self.counters, "latency_bounds_ms": list(bounds), "latency_buckets": buckets})

    def export_records(self, filters: dict[str, str] | None = None, as_of: datetime | None = None) -> DataFrame:
        rows = mutations.export(self.live(as_of), filters)
        return rows if as_of is None else rows.withColumn("ttl_ms", mutations.remaining_ttl(as_of))

    def iterate(self, filters: dict[str, str] | None = None, as_of: datetime | None = None):
        """Rows of export_records, one partition at a time."""
        return self.export_records(filters, as_of).toLocalIterator()

    # -- checkpoints

    def save(self, path: str, overwrite: bool = False) -> dict:
        """Writes a checkpoint with its index; over the one that this engine was loaded from, log and index are rewritten elsewhere first."""
        if overwrite and self._source == path.rstrip("/"):
            self._index = self._index and self._kept(self._index)
            self.compact()
        return checkpoint.write(self.live(), self.cfg, path, self._index, overwrite)

    @classmethod
    def load(cls, spark: SparkSession, path: str, expect: EngineConfig | None = None) -> SearchEngine:
        """The engine of a checkpoint, with its index if it was built. Settings other than the expected ones are refused."""
        cfg, tables = checkpoint.read(spark, path)
        if expect is not None and expect != cfg:
            other = [k for k, v in expect.as_dict().items() if cfg.as_dict()[k] != v]
            raise InvalidArgument(f"{path} has other settings: {', '.join(other)}")
        if "centroids" in tables and tables["centroids"].count() != cfg.ivf_nlist:
            raise InvalidArgument(f"{path} has lists of another number than {cfg.ivf_nlist}")
        out = cls(spark, cfg)
        out._append(tables["records"].withColumn("op", F.lit("upsert")))
        out._source = path.rstrip("/")
        out._index = {k: v for k, v in tables.items() if k != "records"} or None
        return out


