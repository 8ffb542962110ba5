"""2. N-gram Jaccard join over a token-group matrix.

A document's set is its distinct ``n``-word shingles (words between ASCII white space, A-Z lower-cased). Two documents
link when their sets' Jaccard similarity is at least ``percent`` hundredths, tested on whole numbers. The join is exact.

1. Classes. Documents with equal sets (told apart by a 128-bit hash of the set) are one class and are never expanded.
2. Tokens of the matrix. Each class is hashed into parts, so many that two linked classes must agree on at least one whole
   non-empty part (pigeonhole over the largest symmetric difference that a link allows, for each band of set sizes). A
   part's content is a token. Only tokens that two classes share go on.
3. Groups. Classes are put into groups by the least class that any of their shared tokens leads to, so similar classes
   meet; a group that would hold more than ``group_tokens`` shingles or GROUP_CLASSES classes is split by hash. A group's
   token union is stored: its shared tokens (the matrix, token by group) and the union of its shingles.
4. Opening. Two linked classes share several tokens, at least as many as a class's spare parts allow; a class that shares
   fewer with all others is linked with none. Each class is a query to the other groups: its tokens in a group's union
   bound the overlap, and only groups that reach that number are opened for it. Tokens are joined group by group, never
   class by class: two groups whose unions share as many tokens as any class needs are a pair, and the classes of a pair
   are then matched in numpy. In an opened group, a query's overlap with the
   group's shingle union bounds the overlap with any member; only queries whose bound reaches the threshold go on, and
   their intersections are counted by matrix products. A group gives back a spanning forest of its links and, for each
   class, the number of linked documents; pairs of documents are never written.
5. Components come from the forests, by rounds of least-neighbour contraction in Spark.

Edge cases: null and wordless texts have an empty set, link with nothing and are their own component; fewer than n words
are one shingle; rows with a null id keep a null component unless linked; repeated ids count as documents of their own
with that id; an empty table gives no rows. Extra columns are ignored by
``jaccard_classes`` and stay in ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .store import drop, free, stash

N = 3
PERCENT = 90
GROUP_TOKENS = 1 << 17
GROUP_CLASSES = 1024
QUERIES_AT_ONCE = 256  # of a group
SMALL = 100_000  # rows of ids that are broadcast, counted first; more are joined by shuffle
BUCKET_SHINGLES = 1 << 20  # of documents, for a bucket of tokens
BUCKET_TOKENS = 1 << 22  # that are gathered in a bucket at most
PACK_TOKENS = 1 << 19  # that a task packs at once


def shingle_hashes(rows: K.Rows, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, and the bounds of rows."""
    low = K.LOWER[rows.data]
    starts, ends = K.runs(K.NOT_SPACE[low], rows.bounds)
    wb = K.row_of(starts, rows.bounds)
    words = K.span_hash(K.prefix(low), starts, ends)
    at, row = K.within(wb, n)
    grams = K.windows(words, n)[at]
    short = np.flatnonzero((np.diff(wb) > 0) & (np.diff(wb) < n))
    for k in range(1, n):
        some = short[np.diff(wb)[short] == k]
        if len(some):
            grams = np.concatenate((grams, K.windows(words, k, seed=k)[wb[some]]))
            row = np.concatenate((row, some))
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[new], row[new]
    return grams, np.searchsorted(row, np.arange(rows.n + 1))


def bands(percent: int, upto: int) -> list[int]:
    """Edges of bands of set sizes: a set's partners are in its own band or a neighbouring one."""
    edges = [1]
    while edges[-1] <= upto:
        edges.append(max(edges[-1] + 1, edges[-1] * 100 // percent + 1))
    return edges


def parts_of(high: int, percent: int) -> tuple[int, int]:
    """(parts, spare) for sets of at most high shingles. A linked pair differs in at most parts - spare - 1 shingles, so at least spare + 1 parts agree."""
    union = 2 * high * 100 // (100 + percent)
    differ = union * (100 - percent) // 100
    spare = 2 + differ // 4 if differ else 0
    return differ + 1 + spare, spare


def tokens(sets: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrix tokens of each set: their hashes, the set of each, and for each set how many tokens it shares with a linked one at least.

    A frame is ``step`` bands and the next one, so neighbouring bands share a frame; a set is in one frame or, in a band
    that two frames share, in two. Its parts are those of the frame's largest size. Empty parts give no token, unless a
    set has more of them than spare parts.
    """
    size = np.diff(bounds)
    step = 3 if percent >= 85 else 2
    edges = np.array(bands(percent, 4 * int(size.max(initial=1)) + 64))  # more than a frame beyond the largest set
    band = np.searchsorted(edges, size, "right") - 1  # -1 for empty sets
    out_h, out_r = [], []
    need = np.full(len(size), 255)
    owner = np.repeat(np.arange(len(size)), size)
    for back in (0, 1):  # the frame that a band is in, and the one that it ends
        frame = band // step - back
        inside = (band >= 0) & (frame >= 0) & ((band % step == 0) if back else True)
        p, spare = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for f in np.unique(frame[inside]).tolist():
            at = inside & (frame == f)
            p[at], spare[at] = parts_of(int(edges[f * step + step + 1]) - 1, percent)
        base = np.concatenate(([0], np.cumsum(p)))
        keep = inside[owner]
        part = (K.mix(sets[keep] ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)) % p[owner[keep]].astype(np.uint64)
        slot = base[owner[keep]] + part.astype(np.int64)
        total = np.zeros(int(base[-1]), np.uint64)
        np.add.at(total, slot, K.mix(sets[keep] + np.uint64(0x2545F4914F6CDD1D)))
        filled = np.zeros(int(base[-1]), bool)
        filled[slot] = True
        row = np.repeat(np.arange(len(size)), p)
        number = np.arange(len(row)) - base[row]
        empty = np.bincount(row, ~filled, minlength=len(size))
        emit = filled | (empty > spare)[row]
        need = np.where(inside, np.minimum(need, np.maximum(1, spare + 1 - empty.astype(np.int64))), need)
        label = K.mix(number.astype(np.uint64) + (frame[row].astype(np.uint64) << np.uint64(32)))
        out_h.append(K.mix(total ^ label)[emit])
        out_r.append(row[emit])
    return np.concatenate(out_h), np.concatenate(out_r), need


def class_id(grams: np.ndarray) -> bytes:
    return hashlib.md5(grams.tobytes(), usedforsecurity=False).digest()


def _short(name: bytes) -> int:
    return int.from_bytes(name[:8], "little", signed=True)


def _scan(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, class, short, n_shingles); short is 64 bits of class. Both are null for empty sets."""
    schema = docs.select("doc_id").schema.add("class", "binary").add("short", "long").add("n_shingles", "long")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in K.blocks(batch.column(1)):
                sets, bounds = shingle_hashes(rows, n)
                names = [class_id(sets[a:b]) if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                cols = [pa.array(names, pa.binary()), pa.array([None if x is None else _short(x) for x in names], pa.int64()), pa.array(np.diff(bounds).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.first, rows.n), *cols], schema.names)

    return K.mapped(docs.select("doc_id", "text"), of, schema)


_PACK = "bucket int, tokens binary, shorts binary, needs binary"
_ROWS = "token long, short long, need int, least long"
LOW = np.uint64((1 << 48) - 1)


def _pack(docs: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """The matrix tokens of each class, once a task, packed by bucket: 6 bytes of each token, 8 of its class and one of the class's need.

    A bucket is a stretch of the tokens' upper 16 bits, so 48 bits and the bucket tell tokens apart; tokens that agree
    there only lead to a comparison more.
    """

    def blobs(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        token, short, need = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = ((token >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at = np.searchsorted(bucket[order], np.arange(buckets + 1))
        low = np.ascontiguousarray((token[order] & LOW).view(np.uint8).reshape(-1, 8)[:, :6])
        some = np.flatnonzero(np.diff(at))
        cols = [pa.array(some.astype(np.int32)), *[pa.array([x[at[i] : at[i + 1]].tobytes() for i in some.tolist()], pa.binary()) for x in (low, short[order], need[order])]]
        return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _PACK.split(", ")])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for rows in K.blocks(batch.column(0)):
                sets, bounds = shingle_hashes(rows, n)
                first, names = np.zeros(rows.n, bool), np.zeros(rows.n, np.int64)
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    if b > a:
                        names[i] = _short(class_id(sets[a:b]))
                        first[i] = int(names[i]) not in seen
                        seen.add(int(names[i]))
                count = np.diff(bounds)
                h, row, need = tokens(sets[np.repeat(first, count)], np.concatenate(([0], np.cumsum(np.where(first, count, 0)))), percent)
                held.append((h, names[row], need[row].astype(np.uint8)))
                size += len(h)
                if size >= PACK_TOKENS:
                    yield blobs(held)
                    held, size = [], 0
        if size:
            yield blobs(held)

    return K.mapped(docs.select("text"), of, _PACK)


def _shared(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Packed rows in the order of buckets to (token, short, need, least) of tokens that two classes share.

    A bucket of more than ``most`` packed tokens is not gathered: its rows are all passed on, with no least.
    """

    def table(token: np.ndarray, short: np.ndarray, need: np.ndarray, least: np.ndarray | None) -> pa.RecordBatch:
        last = pa.nulls(len(token), pa.int64()) if least is None else pa.array(least)
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(short), pa.array(need.astype(np.int32)), last], ["token", "short", "need", "least"])

    def rows_of(held: list[tuple[bytes, bytes, bytes]], bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low, short, need = (np.frombuffer(b"".join(x), k) for x, k in zip(zip(*held, strict=True), (np.uint8, np.int64, np.uint8), strict=True))
        wide = np.zeros((len(short), 8), np.uint8)
        wide[:, :6] = low.reshape(-1, 6)
        return wide.view(np.int64).ravel() | np.int64(bucket) << np.int64(48), short, need

    def result(held: list[tuple[bytes, bytes, bytes]], bucket: int) -> pa.RecordBatch:
        token, short, need = rows_of(held, bucket)
        order = np.lexsort((short, token))
        token, short, need = token[order], short[order], need[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (short[1:] != short[:-1])
        token, short, need = token[new], short[new], need[new]
        start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        count = np.diff(np.concatenate((start, [len(token)])))
        least = np.repeat(short[start], count)
        keep = np.repeat(count > 1, count)
        return table(token[keep], short[keep], need[keep], least[keep])

    bucket, held, size, large = -1, [], 0, False
    for batch in batches:
        for b, *blob in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
            if b != bucket:
                if held:
                    yield result(held, bucket)
                bucket, held, size, large = b, [], 0, False
            held.append(tuple(x.as_py() for x in blob))
            size += len(held[-1][2])
            if large or size > most:
                large = True
                yield table(*rows_of(held, bucket), None)
                held = []
    if held:
        yield result(held, bucket)


class _Group:
    """Classes with their sets, and the union of these."""

    def __init__(self, names: list[bytes], docs: list[int], sets: list[np.ndarray]):
        self.names, self.docs, self.sets = names, np.array(docs, np.int64), sets
        self.size = np.array([len(s) for s in sets])
        self.all = np.concatenate(sets)
        self.owner = np.repeat(np.arange(len(sets)), self.size)
        self.union = np.unique(self.all)


def open_pair(a: _Group, b: _Group, percent: int, same: bool) -> tuple[list[tuple[bytes, bytes]], dict[bytes, int]]:
    """A spanning forest of the links between (or, if same, within) two groups, and the linked documents of each class."""
    found = np.searchsorted(b.union, a.all)
    hit = b.union[np.minimum(found, len(b.union) - 1)] == a.all
    bound = np.bincount(a.owner, hit, minlength=len(a.names))
    query = np.flatnonzero(100 * bound >= percent * a.size)  # intersection >= percent of the union >= percent of the query
    if not len(query):
        return [], {}
    number = np.full(len(a.names), -1)
    number[query] = np.arange(len(query))
    used = hit & (number[a.owner] >= 0)
    q_row, q_token = number[a.owner[used]], a.all[used]
    columns = np.unique(q_token)
    b_at = np.searchsorted(columns, b.all)
    b_hit = columns[np.minimum(b_at, len(columns) - 1)] == b.all
    b_row, b_col, q_col = b.owner[b_hit], b_at[b_hit], np.searchsorted(columns, q_token)
    overlap = np.zeros((len(query), len(b.names)), np.float32)  # exact: whole numbers below 2**24
    wide = 4096
    q_order, b_order = np.argsort(q_col, kind="stable"), np.argsort(b_col, kind="stable")
    for at in range(0, len(columns), wide):
        qs = q_order[slice(*np.searchsorted(q_col[q_order], (at, at + wide)))]
        bs = b_order[slice(*np.searchsorted(b_col[b_order], (at, at + wide)))]
        x = np.zeros((len(query), min(wide, len(columns) - at)), np.float32)
        y = np.zeros((len(b.names), x.shape[1]), np.float32)
        x[q_row[qs], q_col[qs] - at] = 1
        y[b_row[bs], b_col[bs] - at] = 1
        overlap += x @ y.T
    common = overlap.astype(np.int64)
    linked = 100 * common >= percent * (a.size[query][:, None] + b.size[None, :] - common)
    if same:
        linked[np.arange(len(query)), query] = False
    degree: dict[bytes, int] = {}
    for i, k in enumerate((linked * b.docs[None, :]).sum(1).tolist()):
        if k:
            degree[a.names[query[i]]] = k
    if not same:
        for j, k in enumerate((linked * a.docs[query][:, None]).sum(0).tolist()):
            if k:
                degree[b.names[j]] = k
    forest, root = [], list(range(len(a.names) + (0 if same else len(b.names))))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in np.argwhere(linked).tolist():
        u, v = int(query[i]), j if same else len(a.names) + j
        ru, rv = top(u), top(v)
        if ru != rv:
            root[ru] = rv
            forest.append((a.names[query[i]], b.names[j]))
    return forest, degree


def _load(members) -> _Group:
    return _Group([x["class"] for x in members], [x["docs"] for x in members], [np.frombuffer(x["set"], np.uint64) for x in members])


_LINKS = "a binary, b binary, n long"


def _links_batch(forest: list[tuple[bytes, bytes]], degree: dict[bytes, int]) -> pa.RecordBatch:
    """Edges (a, b, null) and numbers of links (a, null, n) in one table."""
    a = [x for x, _ in forest] + list(degree)
    b = [x for _, x in forest] + [None] * len(degree)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([None] * len(forest) + list(degree.values()), pa.int64())], ["a", "b", "n"])


def _ids(df: DataFrame) -> DataFrame:
    """A written table of ids (under 100 bytes a row), marked for a broadcast if it is small, for a merge join if not."""
    return F.broadcast(df) if df.count() <= SMALL else df.hint("merge")


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of groups (group, queries, union) to (short, group) for the classes that share as many tokens with the group as they need."""
    for batch in batches:
        shorts, groups = [], []
        for i in range(len(batch)):
            own = batch.column(1)[i].values
            token, short, need = (own.field(k).to_numpy() for k in range(3))
            known = np.sort(batch.column(2)[i].values.to_numpy())
            hit = known[np.minimum(np.searchsorted(known, token), len(known) - 1)] == token
            names, at = np.unique(short, return_inverse=True)
            least = np.zeros(len(names), np.int64)
            least[at] = need
            found = names[np.bincount(at[hit], minlength=len(names)) >= least]
            shorts.append(found)
            groups.append(np.full(len(found), batch.column(0)[i].as_py()))
        if shorts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shorts), pa.int64()), pa.array(np.concatenate(groups), pa.int64())], ["short", "group"])


def links(docs: DataFrame, scanned: DataFrame, n: int, percent: int, group_tokens: int) -> DataFrame:
    """(a, b, n) as in _links_batch, for the classes of scanned: a stash.

    Tables and shuffle files go as soon as the next table is written: together they are several times the input.
    """
    spark = docs.sparkSession
    # short stands for the class here: two classes that share it are only grouped together
    whole = scanned.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = int(min(1 << 16, 1 + whole // BUCKET_SHINGLES))
    packed = _pack(docs, n, percent, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    rows = stash(K.mapped(packed, lambda it: _shared(it, BUCKET_TOKENS), _ROWS), "tokens")
    free(spark)
    loose = rows.where("least IS NULL").select("token", "short", "need")
    if not loose.isEmpty():  # of buckets too large to gather: the same by aggregation and join
        least = loose.groupBy("token").agg(F.min("short").alias("least"), F.max("short").alias("most")).where("least <> most").select("token", "least")
        whole_rows, rows = rows, stash(rows.where("least IS NOT NULL").unionByName(loose.distinct().join(least, "token")), "tokens")
        drop(whole_rows)
    # a class that shares fewer tokens with others than a link needs is linked with none
    lead = rows.groupBy("short").agg(F.min("least").alias("lead"), F.count(F.lit(1)).alias("hits"), F.max("need").alias("need")).where("hits >= need").drop("hits")
    counts = scanned.where("class IS NOT NULL").groupBy("class", "short", "n_shingles").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("one"))
    led = stash(counts.join(lead, "short"), "led")
    load = led.groupBy("lead").agg(F.ceil(F.greatest(F.sum("n_shingles") / group_tokens, F.count(F.lit(1)) / GROUP_CLASSES)).alias("splits"))
    grouped = stash(led.join(load, "lead").select("class", "short", "docs", "one", "need", F.xxhash64("lead", F.pmod(F.xxhash64("class"), F.col("splits"))).alias("group")), "groups")
    drop(led)
    # the shingle sets of the classes at hand, from one document of each
    ids = grouped.select(F.col("class").alias("_class"), "group", "docs", F.col("one").alias("_one"))
    texts = docs.select("doc_id", "text").join(_ids(ids), F.col("doc_id").eqNullSafe(F.col("_one"))).select("text", "_class", "group", "docs")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows_ in K.blocks(batch.column(0)):
                sets, bounds = shingle_hashes(rows_, n)
                names, out = batch.column(1).slice(rows_.first, rows_.n).to_pylist(), []
                ok = [class_id(sets[bounds[i] : bounds[i + 1]]) == names[i] for i in range(rows_.n)]
                for i in np.flatnonzero(ok).tolist():
                    out.append(sets[bounds[i] : bounds[i + 1]].tobytes())
                keep = pa.array(ok, pa.bool_())
                others = [batch.column(k).slice(rows_.first, rows_.n).filter(keep) for k in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([*others, pa.array(out, pa.binary())], ["class", "group", "docs", "set"])

    sets = K.mapped(texts, sets_of, "class binary, group long, docs long, set binary")
    # the matrix: each group's tokens, with the class and the need that each belongs to
    own_tokens = rows.select("token", "short").join(grouped.select("short", "group", "need"), "short")
    matrix = stash(own_tokens.groupBy("group").agg(F.collect_list(F.struct("token", "short", "need")).alias("tokens")), "matrix")
    drop(rows)
    gathered = sets.repartition("group").groupBy("group").agg(F.collect_set(F.struct("class", "docs", "set")).alias("members"))
    groups = stash(gathered, "members")
    free(spark)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column(0):
                g = _load(members.as_py())
                yield _links_batch(*(open_pair(g, g, percent, True) if len(g.names) > 1 else ([], {})))

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                yield _links_batch(*open_pair(_load(x.as_py()), _load(y.as_py()), percent, False))

    own = K.mapped(groups.where("size(members) > 1").select("members"), inside, _LINKS)
    # a group's classes are queries to each earlier group whose union has as many of their tokens as a link needs
    union = stash(matrix.select("group", F.array_min("tokens.need").alias("least_need"), F.explode(F.array_distinct("tokens.token")).alias("token")), "unions")
    pairs = union.select("token", "group").join(union.select("token", F.col("group").alias("home"), F.col("least_need").alias("home_need")), "token").where("group < home")
    both = stash(pairs.groupBy("group", "home").agg(F.count(F.lit(1)).alias("common"), F.first("home_need").alias("home_need")).where("common >= home_need").select("group", "home"), "pairs")
    drop(union)
    pairs = both.join(matrix.select(F.col("group").alias("home"), F.col("tokens").alias("queries")), "home").join(matrix.select("group", F.col("tokens.token").alias("union")), "group").select("group", "queries", "union")
    short = stash(K.mapped(pairs, _asked, "short long, group long"), "asked")
    drop(matrix)
    named = stash(short.join(grouped.select("short", F.col("class").alias("query")), "short").select("query", "group"), "asked")
    share = named.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / QUERIES_AT_ONCE).alias("shares"))
    for x in (both, short, grouped):
        drop(x)
    asked = named.join(share, "group").select("query", F.col("group").alias("asked"), F.pmod(F.xxhash64("query"), F.col("shares")).alias("share"))
    one = groups.select(F.explode("members").alias("one")).select(F.col("one.class").alias("query"), "one")
    sent = stash(asked.join(one, "query").groupBy("asked", "share").agg(F.collect_list("one").alias("queries")), "sent")
    free(spark)
    found = stash(own.unionByName(K.mapped(sent.join(groups, F.col("asked") == F.col("group")).select("queries", "members"), between, _LINKS)), "links")
    for x in (sent, named, groups):
        drop(x)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of an edge (a, b) reaches; rounds of least-neighbour contraction."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = stash(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "roots")
    edges = stash(both.where("a < b").distinct(), "edges")
    while True:
        # edges between roots; each root then takes the least root next to it, and chains of roots are halved
        a = edges.join(state.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(state.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        open_ = stash(a.where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "edges")
        hook = open_.groupBy("a").agg(F.min("b").alias("to"))
        up = state.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        if open_.isEmpty():
            jumped = state.join(up, F.col("root") == F.col("_n")).select("node", F.col("_r").alias("root"), (F.col("_r") != F.col("root")).alias("moved"))
            jumped = stash(jumped, "roots")
            state = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                return state
            continue
        hooked = stash(state.join(hook, F.col("root") == F.col("a"), "left").select("node", F.least("root", F.coalesce("to", "root")).alias("root")), "roots")
        up = hooked.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        state = stash(hooked.join(up, F.col("root") == F.col("_n")).select("node", F.col("_r").alias("root")), "roots")
        edges = open_


def jaccard_classes(docs: DataFrame, n: int = N, percent: int = PERCENT, group_tokens: int = GROUP_TOKENS, with_root: bool = False) -> DataFrame:
    """(doc_id, class, n_shingles, component_id, n_links): a row for each document; class is null for empty sets. root is a class that stands for the component."""
    scanned = stash(_scan(docs, n), "scanned")
    found = links(docs, scanned, n, percent, group_tokens)
    roots = components(found.where("b IS NOT NULL"))
    degree = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("far"))
    per = scanned.where("class IS NOT NULL").groupBy("class").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("one"))
    per = per.join(roots.withColumnRenamed("node", "class"), "class", "left").join(degree.withColumnRenamed("a", "class"), "class", "left")
    per = per.withColumn("root", F.coalesce("root", "class"))
    per = stash(per, "roots")
    drop(found)
    least = per.where("root <> class OR far IS NOT NULL").groupBy("root").agg(F.min("one").alias("component"))
    per = stash(per.join(least, "root", "left").select(F.col("class").alias("_class"), "root", F.coalesce("component", "one").alias("component_id"), (F.col("docs") - 1 + F.coalesce("far", F.lit(0))).alias("n_links")), "classes")
    out = scanned.select("doc_id", "class", "n_shingles").join(per, F.col("class") == F.col("_class"), "left")
    return out.select(*(["root"] if with_root else []), "doc_id", "class", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _with_class(docs: DataFrame, n: int) -> DataFrame:
    """docs with _quillon_class, null for empty sets."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[bytes | None] = []
            for rows in K.blocks(batch.column("text")):
                sets, bounds = shingle_hashes(rows, n)
                names += [class_id(sets[a:b]) if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.binary())], [*batch.schema.names, "_quillon_class"])

    return K.mapped(docs, of, T.StructType(list(docs.schema)).add("_quillon_class", "binary"))


def keep_one(docs: DataFrame, n: int = N, percent: int = PERCENT, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """docs without all but one row of each component: the one of the least doc_id (null is the greatest) and class.

    An id that stands twice with unlinked texts is two documents. Rows with empty sets link with nothing and all stay.
    """
    found = jaccard_classes(docs, n, percent, group_tokens, with_root=True)
    found = stash(found.groupBy("doc_id", "class", "root").agg(F.count(F.lit(1)).alias("rows")), "found")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class"))
    winner = stash(found.where("root IS NOT NULL").groupBy(F.col("root").alias("_root")).agg(first.alias("w")), "winners")
    wins = F.col("w.class") == F.col("class")
    stay = F.when(F.col("root").isNull(), F.col("rows")).when(wins & F.col("doc_id").eqNullSafe(F.col("w.doc_id")), 1).otherwise(0)
    marked = stash(found.join(winner, F.col("root") == F.col("_root"), "left").select(F.col("doc_id").alias("_id"), F.col("class").alias("_class"), "rows", stay.alias("stay")), "marked")
    ids = stash(marked.groupBy("_id").agg(F.sum("rows").alias("rows"), F.sum("stay").alias("stay")).where("stay < rows"), "touched")
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    kept = docs.join(_ids(ids.select("_id")), same, "left_anti")
    mixed = stash(ids.where("stay > 0").select("_id"), "mixed")
    if mixed.isEmpty():
        return kept
    # ids with rows of both kinds: their rows are told apart by class
    rows = stash(_with_class(docs.join(_ids(mixed), same, "left_semi"), n), "rows")
    won = marked.where("stay = 1 AND _class IS NOT NULL").select("_id", "_class")
    one = rows.join(won, same & (F.col("_quillon_class") == F.col("_class")), "left_semi").dropDuplicates(["doc_id", "_quillon_class"])
    return kept.unionByName(rows.where("_quillon_class IS NULL").unionByName(one).drop("_quillon_class"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_classes(docs).select("doc_id", "n_shingles", "component_id", "n_links")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS gram FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.reach = l.x),
m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1),
k AS (SELECT x AS doc_id, count(*) AS k FROM l GROUP BY 1)
SELECT m.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(k, 0)::BIGINT AS n_links
FROM m LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
QUERIES = {"op2_jaccard": (op2_jaccard, SQL)}
