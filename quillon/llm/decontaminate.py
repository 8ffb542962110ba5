"""1. Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over token windows.

Words are runs of ASCII digits and letters (A-Z lower-cased) and of any non-ASCII characters. A window is ``n``
consecutive words of a benchmark item, or the whole item if it has fewer words. Window hashes are looked up in a sorted
array; each hit is verified against the words themselves, so that a hash collision never flags a document.

The windows are broadcast in blocks of at most ``block_bytes`` bytes of benchmark text (times a constant), however
large the benchmark grows: each block is one more pass over the rows, and passes are cut by a written table.

Edge cases: a null or wordless text has no hits; a null item text has no windows; items with a null id count in the
hits but not in the list of items; repeated items and repeated documents each count on their own (repeated item ids
once); an empty benchmark or an empty table gives no hits and no rows. Extra columns stay untouched; in
``find_leaks`` a clash with an output name (``n_words n_hit items hits``) overwrites the input's column, and
``decontaminate`` returns the input's columns as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .store import stash

WINDOW = 10
BLOCK_BYTES = 8 << 20
#: What a scan adds. It stands under reserved names until a result is named, so that columns of the input stay as they are.
ADDED = {"n_words": "long", "n_hit": "long", "items": "array<string>", "hits": "array<struct<from:bigint,to:bigint>>"}
RESERVED = "_quillon_"


def _words(rows: K.Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = K.LOWER[rows.data]
    starts, ends = K.runs(K.ALNUM[low], rows.bounds)
    return low, starts, ends, K.row_of(starts, rows.bounds)


def _gram(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, k: int) -> bytes:
    return b" ".join(low[starts[i] : ends[i]].tobytes() for i in range(at, at + k))


def item_windows(items: DataFrame, n: int) -> DataFrame:
    """(k, gram, item): the windows of each item; k is the number of words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for rows in K.blocks(batch.column(1)):
                low, starts, ends, wb = _words(rows)
                k_, gram, item = [], [], []
                for i in range(rows.n):
                    k = min(n, int(wb[i + 1] - wb[i]))
                    if not k:
                        continue
                    grams = {_gram(low, starts, ends, at, k) for at in range(wb[i], wb[i + 1] - k + 1)}
                    k_ += [k] * len(grams)
                    gram += grams
                    item += [ids[rows.first + i].as_py()] * len(grams)
                yield pa.RecordBatch.from_arrays([pa.array(k_, pa.int32()), pa.array(gram, pa.binary()), pa.array(item, pa.string())], ["k", "gram", "item"])

    return K.mapped(items.select(F.col("item_id").cast("string"), "text"), of, "k int, gram binary, item string")


def _index(grams: list[tuple[int, bytes, str | None]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of words: the sorted window hashes, and a table of 2**16 flags over their low bits."""
    out = {}
    for k in {g[0] for g in grams}:
        text = pa.array(sorted({g[1] for g in grams if g[0] == k}), pa.binary())
        found = []
        for rows in K.blocks(text):
            low, starts, ends, _ = _words(rows)
            found.append(K.windows(K.span_hash(K.prefix(low), starts, ends), k)[::k])
        hashes = np.unique(np.concatenate(found))
        flags = np.zeros(1 << 20, bool)
        flags[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        out[k] = hashes, flags
    return out


def _pass(docs: DataFrame, grams: list[tuple[int, bytes, str | None]]) -> DataFrame:
    """Adds one block's hits. Hits are word spans [from, to) in document order, items a sorted list of ids."""
    spark = docs.sparkSession
    owners: dict[bytes, list[str | None]] = {}
    for _, g, item in grams:
        owners.setdefault(g, []).append(item)
    shared = spark.sparkContext.broadcast((_index(grams), owners))
    names = docs.columns
    text_at, hits_at, items_at = names.index("text"), names.index(f"{RESERVED}hits"), names.index(f"{RESERVED}items")
    schema = docs.schema

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, owners = shared.value
        for batch in batches:
            hits_in, items_in = batch.column(hits_at), batch.column(items_at)
            hits, items, n_words, n_hit = [], [], [], []
            for rows in K.blocks(batch.column(text_at)):
                low, starts, ends, wb = _words(rows)
                hashes = K.span_hash(K.prefix(low), starts, ends)
                new: dict[int, list[tuple[int, int]]] = {}
                own: dict[int, set[str]] = {}
                for k, (known, flags) in index.items():
                    w = K.windows(hashes, k)
                    at = np.flatnonzero(flags[(w & np.uint64((1 << 20) - 1)).astype(np.int64)])
                    if not len(at):
                        continue
                    got = w[at]
                    at = at[known[np.minimum(np.searchsorted(known, got), len(known) - 1)] == got]
                    row = np.searchsorted(wb, at, "right") - 1
                    for a, r in zip(at.tolist(), row.tolist(), strict=True):
                        if a + k <= wb[r + 1] and (who := owners.get(_gram(low, starts, ends, a, k))):
                            new.setdefault(r, []).append((a - int(wb[r]), a - int(wb[r]) + k))
                            own.setdefault(r, set()).update(x for x in who if x is not None)
                for i in range(rows.n):
                    spans = [] if i not in new else new[i]
                    old = hits_in[rows.first + i].as_py() or []
                    spans = _union([(x["from"], x["to"]) for x in old] + spans)
                    hits.append([{"from": a, "to": b} for a, b in spans])
                    items.append(sorted(own.get(i, set()) | set(items_in[rows.first + i].as_py() or [])))
                    n_words.append(int(wb[i + 1] - wb[i]))
                    n_hit.append(sum(b - a for a, b in spans))
            cols = {RESERVED + c: x for c, x in (("hits", hits), ("items", items), ("n_words", n_words), ("n_hit", n_hit))}
            arrow = batch.schema
            yield pa.RecordBatch.from_arrays([pa.array(cols[x], arrow.field(i).type) if x in cols else batch.column(i) for i, x in enumerate(names)], schema=arrow)

    return K.mapped(docs, of, schema)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _leaks(docs: DataFrame, benchmark: DataFrame, n: int, block_bytes: int) -> DataFrame:
    """docs with what ADDED names, under reserved names."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + int(size) * n // (block_bytes * n)
    grams = item_windows(benchmark, n).withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(parts)))
    out = docs.withColumns({RESERVED + c: (F.lit(0) if kind == "long" else F.array()).cast(kind) for c, kind in ADDED.items()})
    if parts > 1:
        grams = stash(grams, "grams")
    for part in range(parts):
        block = [tuple(x) for x in grams.where(F.col("part") == part).select("k", "gram", "item").distinct().collect()]
        block = [(k, bytes(g), i) for k, g, i in block]
        out = _pass(out, block)
        if part + 1 < parts:
            out = stash(out, "leaks")
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit (words inside a hit), items (ids whose windows occur) and hits (word spans [from, to))."""
    return _leaks(docs, benchmark, n, block_bytes).drop(*ADDED).withColumnsRenamed({RESERVED + c: c for c in ADDED})


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, remove: str = "documents", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Removes what leaks: whole ``documents`` with a hit, or only the ``spans`` of text from hit word to hit word."""
    names = docs.columns
    found = _leaks(docs, benchmark, n, block_bytes)
    if remove == "documents":
        return found.where(f"{RESERVED}n_hit = 0").select(*names)
    at = found.columns.index("text"), found.columns.index(f"{RESERVED}hits")
    kept = docs.schema
    keep = [found.columns.index(x) for x in names]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[bytes | None] = []
            for rows in K.blocks(batch.column(at[0])):
                low, starts, ends, wb = _words(rows)
                for i in range(rows.n):
                    spans = batch.column(at[1])[rows.first + i].as_py()
                    text, base = rows.text(i), int(rows.bounds[i])
                    for s in reversed(spans):
                        a, b = int(starts[wb[i] + s["from"]]) - base, int(ends[wb[i] + s["to"] - 1]) - base
                        text = text[:a] + text[b:]
                    texts.append(text)
            old = batch.column(at[0])
            new = pa.array([t.decode("utf-8") if old[i].is_valid else None for i, t in enumerate(texts)], old.type)
            yield pa.RecordBatch.from_arrays([new if k == at[0] else batch.column(k) for k in keep], names)

    return K.mapped(found, cut, kept)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.array_sort("items")
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
      FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM g),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram FROM d, ks, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
h AS (SELECT dw.doc_id, dw.k, dw.i, g.item_id FROM dw JOIN g USING (k, gram)),
n AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM h, unnest(range(0, k)) AS t(o) GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""
QUERIES = {"op1_decontaminate": (op1_decontaminate, SQL)}
