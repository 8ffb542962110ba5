"""Navigable small-world graphs, one for each shard, as an approximate candidate router.

Spark has no graph traversal, so a shard's graph is built and searched in numpy, inside grouped Arrow stages. A shard is
a bounded number of vectors (num_shards grows with the corpus, see ``shards``), and each shard is a group of its own.

Levels come from a hash of the key (geometric with ratio 1/m), so that a graph does not depend on row order: vectors are
inserted by key. Search keeps the ef best; ef is at least the number of candidates asked for.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ResourceExhausted
from ..functions.hashing import OFFSET, fnv1a64, shard_of
from . import flat

MOST = 200_000  # vectors of one graph
PER_GRAPH = 2500  # vectors of one graph that a walk of some 80 still searches well
QUERIES = 4096  # queries that walk the graphs in one pass


def level_of(key: str, m: int, seed: int) -> int:
    u = (fnv1a64(key.encode(), fnv1a64(str(seed).encode(), OFFSET)) >> 11) / 2**53
    return int(-math.log(max(u, 2**-53)) / math.log(max(m, 2)))


class Graph:
    """links[level][node]: the node's neighbours on that level."""

    def __init__(self, vectors: np.ndarray, keys: list[str], m: int, ef_construction: int, seed: int):
        self.v = np.nan_to_num(vectors, nan=0.0)
        self.m, self.ef = m, max(ef_construction, m)
        self.links: list[dict[int, list[int]]] = []
        self.entry, self.height = -1, -1
        for i, key in enumerate(keys):
            self._insert(i, level_of(key, m, seed))

    def _near(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        return self.v[nodes] @ q

    def layer(self, q: np.ndarray, start: list[int], ef: int, level: int) -> list[tuple[float, int]]:
        """The ef nearest that a best-first walk reaches, best first."""
        seen = set(start)
        scores = self._near(q, start)
        found = [(s, n) for s, n in zip(scores.tolist(), start, strict=True)]
        heapq.heapify(found)
        todo = [(-s, n) for s, n in found]
        heapq.heapify(todo)
        while todo:
            s, n = heapq.heappop(todo)
            if len(found) >= ef and -s < found[0][0]:
                break
            fresh = [x for x in self.links[level].get(n, ()) if x not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for t, x in zip(self._near(q, fresh).tolist(), fresh, strict=True):
                if len(found) < ef or t > found[0][0]:
                    heapq.heappush(found, (t, x))
                    heapq.heappush(todo, (-t, x))
                    if len(found) > ef:
                        heapq.heappop(found)
        return sorted(found, key=lambda x: (-x[0], x[1]))

    def _prune(self, q: np.ndarray, near: list[tuple[float, int]], most: int) -> list[int]:
        """Keeps a node only if it is closer to q than to any kept one; fills up with the rest."""
        kept, rest = [], []
        for s, n in near:
            if len(kept) == most:
                break
            if not kept or s > float(self._near(self.v[n], kept).max()):
                kept.append(n)
            else:
                rest.append(n)
        return kept + rest[: most - len(kept)]

    def _insert(self, i: int, level: int) -> None:
        while len(self.links) <= level:
            self.links.append({})
        for at in range(level + 1):
            self.links[at][i] = []
        if self.entry < 0:
            self.entry, self.height = i, level
            return
        q, start = self.v[i], [self.entry]
        for at in range(self.height, level, -1):
            start = [self.layer(q, start, 1, at)[0][1]]
        for at in range(min(level, self.height), -1, -1):
            near = self.layer(q, start, self.ef, at)
            most = 2 * self.m if at == 0 else self.m
            self.links[at][i] = self._prune(q, near, self.m)
            for n in self.links[at][i]:
                back = self.links[at][n]
                back.append(i)
                if len(back) > most:
                    scored = sorted(zip(self._near(self.v[n], back).tolist(), back, strict=True), key=lambda x: (-x[0], x[1]))
                    self.links[at][n] = self._prune(self.v[n], scored, most)
            start = [n for _, n in near]
        if level > self.height:
            self.entry, self.height = i, level

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        start = [self.entry]
        for at in range(self.height, 0, -1):
            start = [self.layer(q, start, 1, at)[0][1]]
        return self.layer(q, start, max(ef, k), 0)[:k]


def shards(table: DataFrame, least: int = 1) -> int:
    """So many shards that a graph has about PER_GRAPH vectors: the recall of a walk of one width falls as its graph grows."""
    return max(least, math.ceil(table.count() / PER_GRAPH))


EDGES = "shard int, level int, node string, neighbours array<string>"


def build(table: DataFrame, num_shards: int, m: int = 16, ef_construction: int = 200, seed: int = 42) -> DataFrame:
    """The graphs' adjacency lists: (shard, level, node, neighbours). More than MOST vectors in a shard are refused: take more shards."""
    placed = table.select("key", "vector", shard_of(F.col("key"), num_shards).alias("shard"))
    full = placed.groupBy("shard").count().where(F.col("count") > MOST).orderBy("shard").first()
    if full is not None:
        raise ResourceExhausted(f"shard {full[0]} has {full[1]} vectors, a graph holds {MOST}; take more shards than {num_shards}")

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key").reset_index(drop=True)
        keys = pdf["key"].tolist()
        g = Graph(np.array(pdf["vector"].tolist(), np.float64), keys, m, ef_construction, seed)
        rows = [(int(pdf["shard"][0]), at, keys[n], [keys[x] for x in near]) for at, nodes in enumerate(g.links) for n, near in nodes.items()]
        return pd.DataFrame(rows, columns=["shard", "level", "node", "neighbours"])

    return placed.groupBy("shard").applyInPandas(of, EDGES)


def route(table: DataFrame, edges: DataFrame, queries: DataFrame, num_shards: int, bound: int, ef_search: int = 50) -> DataFrame:
    """(qid, qv, key, vector): candidates of each shard's graph for each query; a pass for each QUERIES queries."""
    kind = queries.schema["qid"].dataType
    schema = T.StructType([T.StructField("qid", kind), T.StructField("qv", T.ArrayType(T.FloatType())), T.StructField("key", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType()))])
    placed = table.select("key", "vector", shard_of(F.col("key"), num_shards).alias("shard"))

    def one_pass(block: list) -> DataFrame:
        shared = table.sparkSession.sparkContext.broadcast(([r[0] for r in block], [np.array(r[1], np.float32) for r in block]))

        def of(points: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
            rows = []
            if len(points):
                points = points.sort_values("key").reset_index(drop=True)
                number = {k: i for i, k in enumerate(points["key"])}
                keys, stored = points["key"].tolist(), points["vector"].tolist()
                g = Graph.__new__(Graph)
                g.v = np.nan_to_num(np.array(stored, np.float64), nan=0.0)
                g.links = [{} for _ in range(int(links["level"].max()) + 1)]
                for level, node, near in zip(links["level"], links["node"], links["neighbours"], strict=True):
                    g.links[level][number[node]] = [number[x] for x in near]
                g.height = len(g.links) - 1
                g.entry = min(g.links[-1])
                for qid, qv in zip(*shared.value, strict=True):
                    rows += [(qid, qv, keys[n], stored[n]) for _, n in g.search(qv.astype(np.float64), bound, ef_search)]
            return pd.DataFrame(rows, columns=["qid", "qv", "key", "vector"])

        return placed.groupBy("shard").cogroup(edges.groupBy("shard")).applyInPandas(of, schema)

    out, block = None, []
    for row in queries.select("qid", "qv").toLocalIterator():
        block.append(row)
        if len(block) == QUERIES:
            out = one_pass(block) if out is None else out.unionByName(one_pass(block))
            block = []
    return out if out is not None and not block else one_pass(block) if out is None else out.unionByName(one_pass(block))


def search(table: DataFrame, edges: DataFrame, queries: DataFrame, num_shards: int, k: int, bound: int | None = None, ef_search: int = 50) -> DataFrame:
    return flat.rerank(route(table, edges, queries, num_shards, max(k, bound or k), ef_search), k).select("qid", "rank", "key", "score")
