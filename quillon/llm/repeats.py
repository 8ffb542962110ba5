"""8. Suffix-array dedup: difference-cover blockwise construction, one suffix bucket at a time.

Every byte that a ``length``-byte string covers is removed if that string also starts anywhere else, in any document.

A text is read in one or two views, which share every stage: its bytes, with windows of ``length`` bytes, and, where
``passage`` is given, its words (between ASCII white space) as four hashed bytes each, with windows of ``passage`` words.
The second view counts the words of passages that occur anywhere else (``n_passage_words``); it removes nothing.

1. Buckets. A window's bucket is its anchor: the place of the smallest hash of a ``kgram``-byte string in it (the leftmost
   of equals). Equal windows have equal anchors at equal offsets, so equal windows meet in one bucket, and a bucket's
   windows are known from the text around its anchor. Spark counts the anchors of all distinct texts; only anchors
   that occur twice or more go on. Identical contexts (the text around an anchor) are counted and merged first, with
   partial sums, so a passage that a third of all rows share is one row here. A context that itself occurs at two places
   is a repeat as a whole.
2. Blocks. Buckets are dealt by anchor hash and packed into blocks of at most ``block_bytes`` of context. In a block, the
   suffixes at the places of a difference cover modulo ``V`` get ranks by doubling (compared up to ``length - V`` bytes).
   Then the block's windows are sorted: first by their first V bytes, and within ties by a three-way quicksort whose
   comparison looks at the cover ranks at the first common cover place of the two suffixes, and the last bytes. Runs of
   equal windows of two or more are the repeats.
3. Large buckets. A bucket of more than ``block_bytes`` is split by what its windows hold besides the anchor: windows whose
   anchor stands at one of the same BIN offsets share all but BIN - 1 of their bytes, the core, if they are equal, and the
   core is the key of a smaller bucket. Cores that occur once go no further, the others' buckets are sorted as above. Only
   where a core's bucket is still larger than a block, its windows go one by one to a distributed sort (a grouping) on the
   bytes outside the core. So no task holds more than a block of a bucket, and no window is left out.
4. Removal. Repeated ranges of windows are gathered for each distinct text, merged, and cut from it.

Texts are told apart by a 128-bit hash. A text that two rows have is a repeat as a whole, if it is long enough. Tables
that are joined on a key with many rows are written first, so that both sides are plain shuffles, which Spark can split.

Edge cases: null is empty, and a text shorter than ``length`` loses nothing; repeated rows, with equal or null ids
too, count as copies of each other; an empty table gives no rows. Extra columns stay in ``remove_repeats``, which adds
``n_bytes n_removed n_spans n_passage_words spans kept`` over columns of these names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .store import drop, free, stash

LENGTH = 400
KGRAM = 96
#: Words of a passage, and of the anchors in it.
PASSAGE = 50
PASSAGE_KGRAM = 12
#: Bytes of a word in the view of words.
CODE = 4
V = 32
BIN = 32
#: A difference cover modulo 32: every difference of two residues occurs between two members. Fixed values.
COVER = (0, 1, 2, 3, 7, 11, 19)
BLOCK_BYTES = 1 << 20


def _cover_shift() -> np.ndarray:
    """shift[a, b]: the least d with (a + d) mod V and (b + d) mod V in the cover."""
    inside = np.isin(np.arange(V), COVER)
    d = np.arange(V)
    a = inside[(d[:, None] + d) % V]  # a[residue, shift]
    both = a[:, None, :] & a[None, :, :]
    assert both.any(2).all()
    return both.argmax(2)


SHIFT = _cover_shift()


@dataclass(frozen=True)
class View:
    """How texts are read: symbols of unit bytes, windows of length bytes, anchors of kgram bytes; 0 is the view of bytes."""

    number: int
    length: int
    kgram: int
    unit: int = 1

    def read(self, rows: K.Rows) -> K.Rows:
        """The rows in this view."""
        if self.unit == 1:
            return rows
        starts, ends = K.runs(K.NOT_SPACE[rows.data], rows.bounds)
        words = (K.span_hash(K.prefix(rows.data), starts, ends) >> np.uint64(32)).astype(np.uint32)
        return K.Rows(words.view(np.uint8), K.row_of(starts, rows.bounds) * CODE, rows.first)

    def read_text(self, text: bytes) -> bytes:
        return self.read(K.Rows(np.frombuffer(text, np.uint8), np.array([0, len(text)]))).data.tobytes() if self.unit > 1 else text


def views(length: int, kgram: int, passage: int | None) -> list[View]:
    return [View(0, length, min(kgram, length)), *([View(1, passage * CODE, min(PASSAGE_KGRAM, passage) * CODE, CODE)] if passage else [])]


def anchors(rows: K.Rows, view: View) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor of each row: its hash, place, row, and the first and last window start that it anchors (places in the block)."""
    none = (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 4)
    n, unit = len(rows.data), view.unit
    if n < view.length:
        return none
    sums = K.prefix(rows.data)
    spans = (sums[view.kgram :: unit] - sums[: n - view.kgram + 1 : unit]) * K.powers("down", len(sums))[: n - view.kgram + 1 : unit]
    h = K.mix(K.mix(spans) + np.uint64(view.number))
    # windows of whole rows, in symbols: row i has the starts first[i], ..., last[i]
    first, last = rows.bounds[:-1] // unit, (rows.bounds[1:] - view.length) // unit
    some = np.flatnonzero(last >= first)
    if not len(some):
        return none
    first, last = first[some], last[some]
    new, find = _window_minima(h, (view.length - view.kgram) // unit + 1)
    lo = np.union1d(new, first)
    row = np.searchsorted(first, lo, "right") - 1
    hi = np.minimum(np.append(lo[1:] - 1, last[-1]), last[row])
    kept = (row >= 0) & (lo <= last[row])
    lo, hi, row = lo[kept], hi[kept], row[kept]
    at = find(lo)
    return h[at], at * unit, some[row], lo * unit, hi * unit


def _window_minima(h: np.ndarray, w: int) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """The windows of w values whose leftmost least value stands elsewhere than that of the window before, and a function from
    windows to the place of it. Block-wise minima from both ends give the least values."""
    n = len(h)
    m = -(-n // w) * w
    padded = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    grid = padded.reshape(-1, w)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()  # least from i to the end of i's block
    left = np.minimum.accumulate(grid, axis=1).ravel()  # least from the start of i's block to i
    least = np.minimum(right[: n - w + 1], left[w - 1 : n])
    # another value, or the place was the first of the window before
    new = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (h[: n - w] == least[:-1]))))
    tails = np.flatnonzero(padded == right)  # where the least value from some i on stands; the first from i on is the leftmost
    fresh = np.empty(m, bool)
    fresh[1:] = left[1:] < left[:-1]
    fresh[::w] = True
    heads = np.flatnonzero(fresh)  # where the leftmost least value up to some i stands

    def find(s: np.ndarray) -> np.ndarray:
        return np.where(right[s] <= left[s + w - 1], tails[np.minimum(np.searchsorted(tails, s), len(tails) - 1)], heads[np.searchsorted(heads, s + w - 1, "right") - 1])

    return new, find


def text_id(text: bytes) -> bytes:
    return hashlib.md5(text, usedforsecurity=False).digest()


PLACE = ("view", "anchor", "place", "off", "lo", "hi")
ANCHORS = "view int, anchor long, place long, text_id binary, off int, lo int, hi int"
CONTEXTS = "view int, anchor long, off int, place long, text_id binary, lo int, context_id binary, context binary"
KEYS = "bucket long, part long, context_id binary, bin int"
SUBS = "view int, bucket long, off int, part long, context_id binary, shift int, sub_id binary, sub binary"
ENDS = "bucket long, o int, rest binary, part long, sub_id binary, at int"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(schema: str, cols: list) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def _number(name: bytes) -> int:
    """64 bits of a 128-bit hash."""
    return int.from_bytes(name[:8], "little", signed=True)


def _scan(texts: DataFrame, read: list[View]) -> DataFrame:
    """The anchors of each text, once a task for copies of a text: off = anchor - lo; lo and hi are window starts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for rows in K.blocks(batch.column(0)):
                ids = [text_id(rows.text(i)) for i in range(rows.n)]
                fresh = np.zeros(rows.n, bool)
                for i, name in enumerate(ids):
                    fresh[i] = name not in seen
                    seen.add(name)
                rows, ids = K.pick(rows, fresh), [x for x, f in zip(ids, fresh.tolist(), strict=True) if f]
                lead = np.array([_number(x) for x in ids], np.int64).view(np.uint64)
                names = pa.array(ids, pa.binary())
                for view in read:
                    seen_as = view.read(rows)
                    h, at, row, lo, hi = anchors(seen_as, view)
                    base = seen_as.bounds[row]
                    place = K.mix(lead[row] ^ K.mix((lo - base).astype(np.uint64)))
                    yield _batch(ANCHORS, [np.full(len(h), view.number, np.int32), h.view(np.int64), place.view(np.int64), names.take(pa.array(row)), (at - lo).astype(np.int32), (lo - base).astype(np.int32), (hi - base).astype(np.int32)])

    return texts.mapInArrow(of, ANCHORS)


def _contexts(batches: Iterator[pa.RecordBatch], read: list[View]) -> Iterator[pa.RecordBatch]:
    """Rows (text_id, text, places) to the text around each of these anchors."""
    seen: set[bytes] = set()
    for batch in batches:
        out: list[list] = [[] for _ in CONTEXTS.split(", ")]
        begin = batch.column(2).offsets.to_numpy()
        number, anchor, place, off, lo, hi = (batch.column(2).values.field(x).to_numpy() for x in PLACE)
        for i, (name, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
            if name in seen:
                continue
            seen.add(name)
            text = text.as_py()
            for view in read:
                at = begin[i] + np.flatnonzero(number[begin[i] : begin[i + 1]] == view.number)
                if not len(at):
                    continue
                data, n = view.read_text(text), len(at)
                around = [data[a:b] for a, b in zip(lo[at].tolist(), (hi[at] + view.length).tolist(), strict=True)]
                marks = np.rec.fromarrays([off[at], anchor[at]], dtype=[("off", "<i4"), ("anchor", "<i8")]).tobytes()
                ids = [text_id(c + marks[12 * k : 12 * k + 12]) for k, c in enumerate(around)]
                for c, v in zip(out, ([view.number] * n, anchor[at], off[at], place[at], [name] * n, lo[at], ids, around), strict=True):
                    c.extend(v)
        yield _batch(CONTEXTS, out)


def bins(off: int, size: int, view: View) -> Iterator[tuple[int, int, int]]:
    """(bin, from, to) for a context of size bytes with its anchor at off: the window starts from, ..., to whose anchor stands at an offset of the bin."""
    for k in range(max(0, off - (size - view.length)) // BIN, off // BIN + 1):
        yield k, max(0, -(-(off - BIN * k - BIN + 1) // view.unit) * view.unit), min(size - view.length, off - BIN * k)


def core(context: bytes, off: int, k: int, view: View) -> bytes:
    """What all windows of bin k hold: all but BIN - 1 of their bytes."""
    at = off - BIN * k
    return context[at : at - BIN + 1 + view.length]


def _keys(batches: Iterator[pa.RecordBatch], read: list[View]) -> Iterator[pa.RecordBatch]:
    """Rows (view, anchor, off, context_id, context) to the buckets of their cores."""
    for batch in batches:
        out: list[list] = [[] for _ in KEYS.split(", ")]
        for number, anchor, off, name, context in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            view = read[number]
            for k, _, _ in bins(off, len(context), view):
                bucket = text_id(core(context, off, k, view) + anchor.to_bytes(8, "little", signed=True) + bytes((k % 256, k // 256)))
                for c, v in zip(out, (_number(bucket), _number(name), name, k), strict=True):
                    c.append(v)
        yield _batch(KEYS, out)


def _subs(batches: Iterator[pa.RecordBatch], read: list[View]) -> Iterator[pa.RecordBatch]:
    """Rows (view, off, context_id, context, found) to the part of the context that the windows of each found (bin, bucket) span."""
    for batch in batches:
        out: list[list] = [[] for _ in SUBS.split(", ")]
        for number, off, name, context, found in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            view, wanted = read[number], {x["bin"]: x["bucket"] for x in found}
            for k, a, b in bins(off, len(context), view):
                if k in wanted:
                    sub = context[a : b + view.length]
                    sub_id = text_id(sub + (off - a).to_bytes(4, "little") + wanted[k].to_bytes(8, "little", signed=True))
                    for c, v in zip(out, (number, wanted[k], off - a, _number(name), name, a, sub_id, sub), strict=True):
                        c.append(v)
        yield _batch(SUBS, out)


def _ends(batches: Iterator[pa.RecordBatch], read: list[View]) -> Iterator[pa.RecordBatch]:
    """Rows (view, bucket, off, sub_id, sub) to their windows: the offset of the anchor, and the bytes outside the core."""
    for batch in batches:
        out: list[list] = [[] for _ in ENDS.split(", ")]
        for number, bucket, off, name, sub in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            view = read[number]
            for at in range(0, len(sub) - view.length + 1, view.unit):
                o = off - at
                inner = off - o // BIN * BIN
                rest = sub[at:inner] + sub[inner - BIN + 1 + view.length : at + view.length]
                for c, v in zip(out, (bucket, o, rest, _number(name), name, at), strict=True):
                    c.append(v)
        yield _batch(ENDS, out)


def sort_block(text: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """True for each window (start in text) that equals another one of the same group.

    The windows are suffixes cut at ``length`` bytes; see the head of this module.
    """
    n = len(text)
    cut = (length - V) // V * V  # bytes that a cover rank stands for
    tail = length - cut
    padded = np.concatenate((text, np.zeros(-n % 8 + (length + 2 * V + 15) // 8 * 8, np.uint8)))
    words = np.empty(len(padded) - 8, np.uint64)  # the eight bytes from each place, as a number in their order
    for i in range(8):
        words[i::8] = padded[i : i + len(padded) - 8].view(">u8")

    def key(at: np.ndarray, k: int) -> np.ndarray:
        return words[at + 8 * k]

    def ranks(x: np.ndarray) -> np.ndarray:
        """Ranks from 0, equal for equal ones."""
        order = np.argsort(x)
        y = x[order]
        out = np.empty(len(x), np.int64)
        out[order] = np.cumsum(np.concatenate(([False], y[1:] != y[:-1])))[: len(x)]
        return out

    def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks by a, then b, both from 0 on and below 2**31."""
        return ranks(a << 31 | b)

    def dense(*keys: np.ndarray) -> np.ndarray:
        """Ranks from 0 by keys, equal for equal ones; a further key orders only what is tied so far."""
        out = ranks(keys[0])
        for x in keys[1:]:
            tied = np.flatnonzero(np.bincount(out)[out] > 1)
            if not len(tied):
                break
            then = np.zeros(len(out), np.int64)
            then[tied] = ranks(x[tied])
            out = pairs(out, then)
        return out

    sample = np.flatnonzero(np.isin(np.arange(n + V) % V, COVER))
    where = np.full(n + length + 2 * V, -1, np.int64)
    where[sample] = np.arange(len(sample))
    rank = dense(*(key(np.minimum(sample, n), k) for k in range(V // 8)))
    size = V
    while size < cut:
        step = min(size, cut - size)
        other = where[np.minimum(sample + step, len(where) - 1)]
        rank = pairs(rank, np.where(other < 0, 0, rank[np.maximum(other, 0)] + 1))
        size += step
    # first V bytes, within a group
    cls = dense(group, *(key(starts, k) for k in range(V // 8)))
    order = np.argsort(cls, kind="stable")
    cls = cls[order]
    at = starts[order]
    tails = [key(at + length - 8 * (k + 1), 0) for k in reversed(range(-(-tail // 8)))]  # in the order of the text
    repeated = np.zeros(len(at), bool)
    live = np.arange(len(at))
    rng = np.random.default_rng(1)
    while len(live):
        # classes of live windows are contiguous; single ones are done
        c = cls[live]
        head = np.concatenate(([True], c[1:] != c[:-1]))
        begin = np.flatnonzero(head)
        count = np.diff(np.concatenate((begin, [len(c)])))
        seg = np.cumsum(head) - 1
        many = count[seg] > 1
        live, seg, begin, count = live[many], seg[many], begin, count
        if not len(live):
            break
        keep = np.flatnonzero(count > 1)
        seg = np.searchsorted(keep, seg)
        count = count[keep]
        begin = np.concatenate(([0], np.cumsum(count)[:-1]))
        pivot = live[begin + (rng.random(len(count)) * count).astype(np.int64)][seg]
        p, q = at[live], at[pivot]
        d = SHIFT[p % V, q % V]
        a, b = rank[where[p + d]], rank[where[q + d]]
        side = np.sign(a - b)
        for t in tails:
            x, y = t[live], t[pivot]
            side = np.where(side == 0, (x > y).astype(np.int64) - (x < y).astype(np.int64), side)
        equal = np.bincount(seg, side == 0)[seg]
        done = side == 0
        repeated[live[done & (equal > 1)]] = True
        live, seg, side = live[~done], seg[~done], side[~done]
        parts = seg * 2 + (side > 0)
        split = np.argsort(parts)
        live = live[split]
        cls[live] = parts[split]
    out = np.zeros(len(starts), bool)
    out[order] = repeated
    return out


def _ranges(batches: Iterator[pa.RecordBatch], read: list[View], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows (view, bucket, off, id, bytes), sorted by view and bucket, to (id, from, to): ranges of repeated windows."""
    held: list[tuple[int, int, int, bytes, bytes]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        ids, lo_, hi_ = [], [], []
        view = read[held[0][0]]
        text = np.frombuffer(b"".join(x[4] for x in held), np.uint8)
        sizes = np.array([len(x[4]) for x in held], np.int64)
        base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        windows = (sizes - view.length) // view.unit + 1
        owner = np.repeat(np.arange(len(held)), windows)
        within = (np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(windows)[:-1])), windows)) * view.unit
        bucket = np.unique(np.array([x[1] for x in held]), return_inverse=True)[1]
        off = np.array([x[2] for x in held])
        group = bucket[owner] * view.length + off[owner] - within  # the same anchor at the same offset
        hit = sort_block(text, base[owner] + within, group, view.length)
        head = np.concatenate(([True], (owner[1:] != owner[:-1]) | ~hit[:-1]))
        first = np.flatnonzero(hit & head)
        tail = np.concatenate(((owner[1:] != owner[:-1]) | ~hit[1:], [True]))
        last = np.flatnonzero(hit & tail)
        ids = [held[i][3] for i in owner[first].tolist()]
        lo_, hi_ = within[first].astype(np.int32), within[last].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(lo_), pa.array(hi_)], ["id", "from", "to"])

    last = None
    for batch in batches:
        for x in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if held and (x[0] != held[0][0] or x[1] != last and size >= block_bytes):
                yield flush()
                held, size = [], 0
            last = x[1]
            held.append(x)
            size += len(x[4])
    if held:
        yield flush()


RANGE = "id binary, from int, to int"


def _sorted_ranges(sized: DataFrame, read: list[View], block_bytes: int) -> DataFrame:
    """RANGE for rows (view, bucket, off, id, bytes) whose buckets fit in a block."""
    dealt = sized.repartition("bucket").sortWithinPartitions("view", "bucket")
    return dealt.select("view", "bucket", "off", "id", "bytes").mapInArrow(lambda it: _ranges(it, read, block_bytes), RANGE)


def _loads(rows: DataFrame) -> DataFrame:
    """Written (bucket, load, n): the bytes of each bucket of two or more rows."""
    return stash(rows.groupBy("bucket").agg(F.sum(F.octet_length("bytes")).alias("load"), F.count(F.lit(1)).alias("n")).where("n > 1"), "loads")


def _large_ranges(large: DataFrame, read: list[View], block_bytes: int) -> DataFrame:
    """RANGE for rows (view, bucket, off, id, bytes) of buckets larger than a block."""
    keys = stash(large.select("view", "bucket", "off", "id", "bytes").mapInArrow(lambda it: _keys(it, read), KEYS), "keys")
    twice = stash(keys.groupBy("bucket").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("bucket"), "twice")
    found = stash(keys.join(twice, "bucket", "left_semi").groupBy("context_id").agg(F.collect_set(F.struct("bin", "bucket")).alias("found")), "found")
    some = large.join(found, F.col("id") == F.col("context_id")).select("view", "off", "id", "bytes", "found")
    subs = stash(some.mapInArrow(lambda it: _subs(it, read), SUBS), "subs")
    merged = subs.groupBy("sub_id").agg(F.first("view").alias("view"), F.first("bucket").alias("bucket"), F.first("off").alias("off"), F.first("sub").alias("bytes"), (F.min("part") != F.max("part")).alias("again"))
    merged = stash(merged.withColumnRenamed("sub_id", "id"), "merged")
    sized = merged.join(_loads(merged), "bucket")
    by_sort = _sorted_ranges(sized.where(F.col("load") <= block_bytes), read, block_bytes)
    ends = stash(sized.where(F.col("load") > block_bytes).select("view", "bucket", "off", "id", "bytes").mapInArrow(lambda it: _ends(it, read), ENDS), "ends")
    same = ["bucket", "o", "rest"]
    again = stash(ends.groupBy(*same).agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select(*same), "again")
    by_ends = ends.join(again, same, "left_semi").select(F.col("sub_id").alias("id"), F.col("at").alias("from"), F.col("at").alias("to"))
    ranges = by_sort.unionByName(by_ends).unionByName(_whole(merged, read))
    placed = subs.select("sub_id", "context_id", "shift").distinct().join(ranges, F.col("sub_id") == F.col("id"))
    return placed.select(F.col("context_id").alias("id"), (F.col("shift") + F.col("from")).alias("from"), (F.col("shift") + F.col("to")).alias("to"))


def _whole(merged: DataFrame, read: list[View]) -> DataFrame:
    """RANGE of what occurs at two places: all its windows."""
    length = F.coalesce(*[F.when(F.col("view") == v.number, F.lit(v.length)) for v in read])
    return merged.where("again").select("id", F.lit(0).alias("from"), (F.octet_length("bytes") - length).alias("to"))


def with_text_id(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("text_id", F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))


def repeated_ranges(docs: DataFrame, text_col: str = "text", length: int = LENGTH, kgram: int = KGRAM, block_bytes: int = BLOCK_BYTES, passage: int | None = None) -> DataFrame:
    """(text_id, ranges): for each distinct text, by view, the ranges [from, to] of window starts that occur at another place of the distinct texts."""
    read = views(length, kgram, passage)
    texts = docs.select(F.col(text_col).alias("text")).where(F.octet_length("text") >= min(length, *([2 * passage - 1] if passage else [length])))
    found = stash(_scan(texts, read), "anchors")
    twice = stash(found.groupBy("anchor").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a <> b").select("anchor"), "twice")
    free(docs.sparkSession)
    hot = stash(found.join(twice, "anchor", "left_semi").groupBy("text_id").agg(F.collect_set(F.struct(*PLACE)).alias("places")), "places")
    drop(found)
    joined = with_text_id(texts).join(hot, "text_id").select("text_id", F.col("text").cast("binary").alias("text"), "places")
    near = stash(joined.mapInArrow(lambda it: _contexts(it, read), CONTEXTS), "contexts")
    drop(hot)
    merged = near.groupBy("context_id").agg(F.first("view").alias("view"), F.first("anchor").alias("bucket"), F.first("off").alias("off"), F.first("context").alias("bytes"), (F.min("place") != F.max("place")).alias("again"))
    merged = stash(merged.withColumnRenamed("context_id", "id"), "merged")
    drop(twice)
    where = stash(near.select("context_id", "view", "text_id", "lo").distinct(), "where")
    drop(near)
    loads = _loads(merged)
    sized = merged.join(loads, "bucket")
    ranges = _sorted_ranges(sized.where(F.col("load") <= block_bytes), read, block_bytes).unionByName(_whole(merged, read))
    if not loads.where(F.col("load") > block_bytes).isEmpty():
        ranges = ranges.unionByName(_large_ranges(stash(sized.where(F.col("load") > block_bytes).drop("load", "n"), "large"), read, block_bytes))
    placed = where.join(ranges, F.col("context_id") == F.col("id")).select("text_id", F.struct("view", (F.col("lo") + F.col("from")).alias("from"), (F.col("lo") + F.col("to")).alias("to")).alias("r"))
    out = stash(placed.groupBy("text_id").agg(F.collect_set("r").alias("ranges")), "ranges")
    for x in (merged, where):
        drop(x)
    return out


def _spans(found: list[tuple[int, int]]) -> list[list[int]]:
    """Sorted maximal spans that cover the given ones."""
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, kgram: int = KGRAM, block_bytes: int = BLOCK_BYTES, digest: bool = False, passage: int | None = None) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, spans (byte spans [from, to)) and kept (the remaining bytes); with digest, kept_sha256 instead of the last two and of the text; with passage, n_passage_words: words in passages of that many words that occur twice."""
    read = views(length, kgram, passage)
    ranges = repeated_ranges(docs, text_col, length, kgram, block_bytes, passage)
    named = with_text_id(docs, text_col)
    copies = named.groupBy("text_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("text_id", F.lit(True).alias("whole"))
    info = stash(ranges.join(copies, "text_id", "full_outer").select(F.col("text_id").alias("_text_id"), F.col("ranges").alias("_ranges"), F.coalesce("whole", F.lit(False)).alias("_whole")), "info")
    drop(ranges)
    added = ["n_bytes", "n_removed", "n_spans", *(["n_passage_words"] if passage else []), *(["kept_sha256"] if digest else ["spans", "kept"])]
    keep = [c for c in docs.columns if c not in added and not (digest and c == text_col)]
    joined = named.join(info, F.col("text_id") == F.col("_text_id"), "left").select(*keep, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"), F.coalesce("_ranges", F.array()).alias("_ranges"), F.coalesce("_whole", F.lit(False)).alias("_whole"))
    schema = joined.select(*keep).schema
    for c in added:
        schema = schema.add(c, {"kept_sha256": "string", "kept": "binary", "spans": T.ArrayType(T.StructType().add("from", "long").add("to", "long"))}.get(c, "long"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in added}
            begin = batch.column(len(keep) + 1).offsets.to_numpy()
            number, lo, hi = (batch.column(len(keep) + 1).values.field(x).to_numpy() for x in ("view", "from", "to"))
            for i, (text, whole) in enumerate(zip(batch.column(len(keep)), batch.column(len(keep) + 2).to_pylist(), strict=True)):
                text, mine = text.as_py(), slice(begin[i], begin[i + 1])
                if whole:
                    found = [[(0, n)] if (n := len(v.read_text(text))) >= v.length else [] for v in read]
                else:
                    found = [list(zip(lo[mine][at].tolist(), (hi[mine][at] + v.length).tolist(), strict=True)) for v in read for at in [number[mine] == v.number]]
                spans, parts, at = _spans(found[0]), [], 0
                for a, b in spans:
                    parts.append(text[at:a])
                    at = b
                rest = b"".join([*parts, text[at:]])
                row = {"n_bytes": len(text), "n_removed": len(text) - len(rest), "n_spans": len(spans)}
                if passage:
                    row["n_passage_words"] = sum(b - a for a, b in _spans(found[1])) // CODE
                row |= {"kept_sha256": hashlib.sha256(rest).hexdigest()} if digest else {"spans": [{"from": a, "to": b} for a, b in spans], "kept": rest}
                for c, v in row.items():
                    out[c].append(v)
            kinds = {"kept_sha256": pa.string(), "kept": pa.binary(), "spans": pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))}
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *[pa.array(out[c], kinds.get(c, pa.int64())) for c in added]], schema.names)

    return joined.mapInArrow(cut, schema)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), digest=True, passage=PASSAGE)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM d, unnest(range(0, n - 399)) AS x(i) WHERE n >= 400),
s AS (SELECT doc_id, i FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
o AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM s),
g AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM o),
sp AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY doc_id, g),
pc AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM sp),
r AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS b, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept FROM pc JOIN d USING (doc_id) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS l FROM d),
v AS (SELECT doc_id, i, md5(array_to_string(l[i:i + 49], ' ')) AS k FROM l, unnest(range(1, len(l) - 48)) AS x(i) WHERE len(l) >= 50),
q AS (SELECT doc_id, i FROM v SEMI JOIN (SELECT k FROM v GROUP BY k HAVING count(*) > 1) USING (k)),
c AS (SELECT doc_id, sum(least(50, e - i)) AS n FROM (SELECT doc_id, i, lead(i, 1, i + 50) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM q) GROUP BY doc_id)
SELECT d.doc_id, n_bytes::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(c.n, 0)::BIGINT AS n_passage_words,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(b, 0) + 1))) AS kept_sha256
FROM (SELECT *, n AS n_bytes FROM d) AS d LEFT JOIN r USING (doc_id) LEFT JOIN c USING (doc_id)
"""
QUERIES = {"op8_repeats": (op8_repeats, SQL)}
