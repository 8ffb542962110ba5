"""Spherical k-means: assignment by the largest dot product, unit-length means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import InvalidArgument
from ..functions import vectors as V
from ..functions.hashing import fnv_hex
from .flat import ROWS, matrix

ITERATIONS = 20
MOST = 1 << 16  # centroids that are held by the driver and each worker


def initial(table: DataFrame, k: int) -> DataFrame:
    """(cid, centroid): the k vectors of the least key hashes, unit length."""
    first = table.withColumn("_h", fnv_hex(F.col("key").cast("string"))).orderBy("_h", "key").limit(k)
    rows = [(i, [float(x) for x in r[0]]) for i, r in enumerate(first.select(V.normalize(F.col("vector"))).collect())]  # k rows
    if len(rows) < k:
        raise InvalidArgument(f"{k} centroids need as many vectors")
    return table.sparkSession.createDataFrame(rows, "cid int, centroid array<float>")


def rows_of(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(cids in order, centroids as doubles), checked to be at most MOST."""
    rows = sorted((r[0], r[1]) for r in centroids.select("cid", "centroid").limit(MOST + 1).collect())
    if len(rows) > MOST:
        raise InvalidArgument(f"more than {MOST} centroids")
    return np.array([r[0] for r in rows], np.int32), np.array([r[1] for r in rows], np.float64)


def _nearest(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Place of the largest dot product, the first of equals, -1 if all are NaN."""
    with np.errstate(all="ignore"):
        s = v @ centroids.T
        s = np.where(np.isnan(s), -np.inf, s)
        best = s.max(1)
        floor = best - 1e-9 * np.maximum(1, np.abs(np.where(np.isinf(best), 0, best)))
        out = s.argmax(1)
        for i in np.flatnonzero((s >= floor[:, None]).sum(1) > 1):  # close ones: sums from left to right, as elsewhere
            near = np.flatnonzero(s[i] >= floor[i])
            out[i] = near[np.cumsum(v[i] * centroids[near], 1)[:, -1].argmax()] if best[i] > -np.inf else near[0]
        return np.where(np.isnan(v @ centroids.T).all(1), -1, out)


def _batches(whole: pa.RecordBatch, at: int, centroids: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows with a vector, their matrix, their nearest places) in blocks; rows without one come with an empty matrix and -1."""
    lost = pc.is_null(whole.column(at))
    for some, known in ((whole.filter(pc.invert(lost)), True), (whole.filter(lost), False)):
        for lo in range(0, some.num_rows, ROWS):
            part = some.slice(lo, ROWS)
            v = matrix(part.column(at)) if known else np.empty((part.num_rows, 0))
            yield part, v, _nearest(v, centroids) if known else np.full(part.num_rows, -1)


def assign(table: DataFrame, centroids: DataFrame) -> DataFrame:
    """table with cid: the centroid of the largest dot product, the least cid of equals, -1 if all are NaN or the vector is null.

    One pass without a shuffle: batches of vectors times all centroids.
    """
    cids, c = rows_of(centroids)
    shared = table.sparkSession.sparkContext.broadcast((np.append(cids, np.int32(-1)), c))
    at = table.columns.index("vector")
    names = [*table.columns, "cid"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c = shared.value
        for whole in batches:
            for part, _, place in _batches(whole, at, c):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids[place], pa.int32())], names)

    return table.mapInArrow(of, T.StructType([*table.schema.fields, T.StructField("cid", T.IntegerType())]))


def step(table: DataFrame, centroids: DataFrame) -> DataFrame:
    """One round: the unit-length mean of each cluster; an empty cluster keeps its centroid.

    Each task sums its rows by cluster and passes on at most as many rows as there are centroids.
    """
    cids, c = rows_of(centroids)
    shared = table.sparkSession.sparkContext.broadcast((cids, c))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c = shared.value
        total, n = np.zeros_like(c), np.zeros(len(ids), np.int64)
        for whole in batches:
            for _, v, place in _batches(whole, 0, c):
                v, place = v[place >= 0], place[place >= 0]
                if len(v):
                    np.add.at(total, place, v)
                    n += np.bincount(place, minlength=len(ids))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int32()), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.float64()))], ["cid", "n", "total"])

    parts = table.select("vector").mapInArrow(of, "cid int, n long, total array<double>")
    sums = parts.select("cid", "n", F.posexplode("total").alias("pos", "x")).groupBy("cid", "pos").agg((F.sum("x") / F.sum("n")).alias("x"))
    rows = sums.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"].cast("float")).alias("mean"))
    return centroids.join(F.broadcast(rows), "cid", "left").select("cid", F.coalesce(V.normalize(F.col("mean")), "centroid").alias("centroid"))


def train(table: DataFrame, k: int, iterations: int = ITERATIONS) -> DataFrame:
    """(cid, centroid), until no centroid moves or after so many rounds. The k centroids pass through the driver each round."""
    spark = table.sparkSession
    centroids = initial(table, k)
    for _ in range(iterations):
        rows = [(r[0], [float(x) for x in r[1]]) for r in step(table, centroids).orderBy("cid").collect()]  # k rows
        old = [(r[0], [float(x) for x in r[1]]) for r in centroids.orderBy("cid").collect()]
        centroids = spark.createDataFrame(rows, "cid int, centroid array<float>")
        if all(max(abs(a - b) for a, b in zip(x[1], y[1], strict=True)) < 1e-7 for x, y in zip(rows, old, strict=True)):
            break
    return centroids
