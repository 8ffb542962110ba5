"""7. Quality rules: n-gram perplexity, with language-specific upper and lower bands.

The language model is a modified Kneser-Ney model of order 6 over bytes (A-Z lower-cased; spaces stand before a row).
Nothing about it is capped: it holds every six-gram of what it is trained on and grows with it.

Documents are dealt to two folds by the least hash of their windows of five words, so equal and nearly equal texts mostly
share one, and each document is scored by the model of the other fold: its own words and its copies do not make it likely.
Texts that fail the base rules train nothing. Junk that passes them would still make junk likely, so ROUNDS models are
trained in turn: each but the first leaves out what the one before put further than TRIM spreads outside the quartiles of
its language. Left out texts are known by 64-bit hashes, broadcast in blocks. All texts are scored, whatever trained.

1. Counting, once. Every task sorts the six-grams of its rows a block at a time and emits distinct ones with counts,
   packed into one row for each bucket of keys (fold and last two bytes of the context); Spark deals the buckets out. So the grams of a part, and their shorter suffixes
   down to order 3, have all that their counts, contexts and continuations need in that part, whatever its size.
   For each later model the grams of the left out texts are counted and subtracted.
2. Training. Counts of counts are summed over the parts for the discounts, and the grams of order 2 (at most 2**16)
   and 1 come to the driver. Then each part computes its probabilities by itself: sorted arrays of grams and of log
   probabilities (fixed point, so that sums do not depend on their order).
3. Scoring. The driver reads the parts BLOCK_GRAMS grams at a time, sorts them and broadcasts them, one block after
   the other. Workers look up the distinct grams of their rows by binary search; they keep up to RESIDENT blocks in
   memory, and beyond that read them in turn for each 16 MB of text. Each gram is in exactly one block, with its
   suffixes and its contexts' weights; a gram that the model lacks backs off to the longest suffix that it has.

A document's log perplexity (nats a byte) is compared with bands of its language: quartiles of all documents of that
language that pass the base rules, widened by ``width`` times the spread between the quartiles (taken as at least ``floor``, for clean text of which the corpus holds copies to stay).
Quartiles come from exact counts over bins of 0.001, so they do not depend on partitioning. Documents outside the band
are rejected, on either side.

Edge cases: null and wordless texts have no words, fail the base rules and have a null perplexity; a null language is a
language of its own; a language with fewer than ``least`` passing documents has no band and rejects nothing; repeated
rows count each; an empty table gives no rows. Extra columns are kept by ``with_quality``, which overwrites columns of
its output names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .store import stash

ORDER = 6
BITS = 8
#: Orders up to this one are counted as a whole; those above it in parts.
LOW = 2
SCALE = 1 << 20
SPACES = int.from_bytes(b" " * ORDER)
#: Bits of a row number beside a six-gram in one sorted value.
ROW_BITS = 16
HOLD = 1 << 22
PART_GRAMS = 1 << 19
PART_BYTES = 16 << 20
BLOCK_GRAMS = 1 << 22
RESIDENT = 4
GRAMS = "bucket int, grams binary, counts binary"
PARTS = "at long, size long, grams binary, counts binary, seen array<long>, pairs array<int>, follows array<long>"
MODEL = "at long, size long, grams binary, logs binary, lower binary, lower_logs binary"
WIDTH = 4.0
FLOOR = 0.1
LEAST = 20
ROUNDS = 3
TRIM = 0.5
FOLD_WORDS = 5
HELD_MARKS = 1 << 22
MIN_WORDS = 50
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_ppl double"

SYMBOL = K.lut(lambda b: chr(b) in "#*$%&|<>")


def codes(rows: K.Rows) -> np.ndarray:
    """The six-gram that ends at each byte, the last byte lowest; before a row's start stand spaces."""
    n = len(rows.data)
    padded = np.full(n + 7, 0x20, np.uint8)
    padded[7:] = K.LOWER[rows.data]
    out = np.ndarray(n, ">u8", padded, strides=(1,)).astype(np.int64)  # the eight bytes that end at each byte
    out &= (1 << (BITS * ORDER)) - 1
    for j in range(1, ORDER):  # bytes of the row before do not reach into this one
        at = rows.bounds[:-1] + j - 1
        at = at[at < rows.bounds[1:]]
        out[at] = out[at] & ((1 << (BITS * j)) - 1) | SPACES >> (BITS * j) << (BITS * j)
    return out


def tally(grams: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams and their counts, each row counting n or 1."""
    if n is None:
        grams = np.sort(grams)
    else:
        order = np.argsort(grams)
        grams, n = grams[order], n[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(grams)), bool), grams[1:] != grams[:-1])))
    if n is None:
        return grams[first], np.diff(np.append(first, len(grams)))
    return grams[first], np.add.reduceat(n, first) if len(first) else n


def _key(grams: np.ndarray) -> np.ndarray:
    """The last LOW bytes of a gram's context: equal for grams that share a context or a suffix of order above LOW. Above them stands the fold."""
    return (grams >> BITS) & ((1 << (BITS * LOW)) - 1) | (grams >> (BITS * ORDER)) << (BITS * LOW)


class Words:
    """The words of a block of rows: their places, the first word of each row, hashes, and the sums that spans are hashed from."""

    def __init__(self, rows: K.Rows):
        self.rows, self.hashes = rows, K.prefix(rows.data)
        self.bytes = K.NOT_SPACE[rows.data]
        self.starts, ends = K.runs(self.bytes, rows.bounds)
        self.bounds = K.row_of(self.starts, rows.bounds)
        self.each = K.span_hash(self.hashes, self.starts, ends)


def fold_of(words: Words) -> np.ndarray:
    """0 or 1 for each row, by the least hash of its windows of words; fewer words than a window give all rows one fold."""
    at, row = K.within(words.bounds, FOLD_WORDS)
    least = np.full(words.rows.n, 2**64 - 1, np.uint64)
    if len(at):
        np.minimum.at(least, row, K.windows(words.each, FOLD_WORDS)[at])
    return (K.mix(least) & np.uint64(1)).astype(np.int64)


def marks(rows: K.Rows, hashes: np.ndarray) -> np.ndarray:
    """A hash of each row's text."""
    return K.span_hash(hashes, rows.bounds[:-1], rows.bounds[1:]).view(np.int64)


def levels(grams: np.ndarray, counts: np.ndarray, lowest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted grams and counts by order, from lowest up; below the highest order a count is that of distinct continuations to the left."""
    out = [(grams, counts)]
    order = ORDER if lowest > LOW else LOW
    while order > lowest:
        order -= 1
        out.insert(0, tally(out[0][0] & ((1 << (BITS * order)) - 1)))
    return out


def counts_of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


def _grams(docs: DataFrame, text_col: str, grams_of: Callable[[K.Rows], np.ndarray], n_parts: int, sign: int = 1) -> DataFrame:
    """GRAMS: the grams of each task's rows, n times sign."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return tally(*(np.concatenate(x) for x in zip(*held, strict=True)))

        for batch in batches:
            for rows in K.blocks(batch.column(0)):
                held.append(tally(grams_of(rows)))
                size += len(held[-1][0])
                if size > HOLD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HOLD // 2:
                        yield from _gram_rows(held[0][0], sign * held[0][1], _buckets(n_parts))
                        held, size = [], 0
        if held:
            grams, n = merged()
            yield from _gram_rows(grams, sign * n, _buckets(n_parts))

    return docs.select(text_col).mapInArrow(of, GRAMS)


def _gram_rows(grams: np.ndarray, n: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """GRAMS: grams and counts packed by bucket; a key is in one bucket."""
    own = (K.mix(_key(grams).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(own)
    own, grams, n = own[order], grams[order], n[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(own)), bool), own[1:] != own[:-1])))
    edges = np.append(first, len(own))
    for i in range(0, len(first), 1 << 12):
        cuts = [slice(x, y) for x, y in zip(edges[i : i + (1 << 12)], edges[i + 1 : i + 1 + (1 << 12)], strict=False)]
        packed = [pa.array([values[x].tobytes() for x in cuts], pa.binary()) for values in (grams, n)]
        yield pa.RecordBatch.from_arrays([pa.array(own[first[i : i + (1 << 12)]]), *packed], ["bucket", "grams", "counts"])


def _gathered(grams: DataFrame, n_parts: int) -> DataFrame:
    """PARTS from GRAMS; grams whose counts sum to 0 go."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.frombuffer(g.as_buffer(), np.int64), np.frombuffer(n.as_buffer(), np.int64)) for b in batches for g, n in zip(b.column("grams"), b.column("counts"), strict=True)]
        if not sum(len(g) for g, _ in held):
            return
        grams, n = tally(*(np.concatenate(x) for x in zip(*held, strict=True)))
        del held
        grams, n = grams[n > 0], n[n > 0]
        order = np.argsort(_key(grams), kind="stable")
        grams, n, key = grams[order], n[order], _key(grams)[order]
        edges = np.flatnonzero(key[1:] != key[:-1]) + 1
        at = 0
        while at < len(grams):  # a part has whole keys
            later = edges[edges >= at + PART_GRAMS]
            to = int(later[0]) if len(later) else len(grams)
            split = int(np.searchsorted(key, 1 << (BITS * LOW)))  # and one fold
            to = min(to, split) if at < split else to
            part = tally(grams[at:to] & ((1 << (BITS * ORDER)) - 1), n[at:to])
            tables = levels(*part, LOW + 1)
            pairs, follows = tally(tables[0][0] & ((1 << (BITS * LOW)) - 1))
            seen = [x for _, counts in tables for x in counts_of_counts(counts)]
            row = {"at": int(key[at]), "size": to - at, "grams": part[0].tobytes(), "counts": part[1].tobytes(), "seen": seen, "pairs": pairs.tolist(), "follows": follows.tolist()}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("at", pa.int64()), ("size", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary()), ("seen", pa.list_(pa.int64())), ("pairs", pa.list_(pa.int32())), ("follows", pa.list_(pa.int64()))]))
            at = to

    return grams.repartition(n_parts, "bucket").mapInArrow(gather, PARTS)


def _buckets(n_parts: int) -> int:
    """Several buckets a part, so that parts come out even."""
    return min(1 << (BITS * LOW), 8 * n_parts)


def _n_parts(docs: DataFrame, text_col: str) -> int:
    whole = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return int(min(1 << (BITS * LOW), whole // PART_BYTES + 1))


def _with_fold(words: Words) -> np.ndarray:
    """The six-grams of the rows, with the row's fold above them."""
    return codes(words.rows) | np.repeat(fold_of(words), np.diff(words.rows.bounds)) << (BITS * ORDER)


def count_ngrams(docs: DataFrame, text_col: str = "text", folds: bool = False, n_parts: int | None = None) -> DataFrame:
    """PARTS: the six-grams of all documents with their counts, each part with all grams of its keys.

    With folds, of the documents that pass the base rules, and each fold has its own parts.
    """

    def passing(rows: K.Rows) -> np.ndarray:
        words = Words(rows)
        grams = _with_fold(words)
        return grams[np.repeat(~base_failed(word_stats(words)), np.diff(rows.bounds))]

    n_parts = n_parts or _n_parts(docs, text_col)
    return _gathered(_grams(docs, text_col, passing if folds else codes, n_parts), n_parts)


def leave_out(parts: DataFrame, docs: DataFrame, left_out: list[Broadcast], text_col: str, n_parts: int) -> DataFrame:
    """PARTS with folds less the grams of the documents whose hashes are left out; all of those pass the base rules, so parts hold them."""

    def left(rows: K.Rows) -> np.ndarray:
        own = marks(rows, K.prefix(rows.data))
        take = np.zeros(rows.n, bool)
        for block in left_out:
            take |= _has(block.value, own)
            _let_go(block, len(left_out))
        return _with_fold(Words(K.pick(rows, take)))

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fold = row["at"] >> (BITS * LOW) << (BITS * ORDER)
                yield from _gram_rows(np.frombuffer(row["grams"], np.int64) | fold, np.frombuffer(row["counts"], np.int64), _buckets(n_parts))

    if not left_out:
        return parts
    counted = parts.select("at", "grams", "counts").mapInArrow(unfold, GRAMS)
    return _gathered(counted.unionByName(_grams(docs, text_col, left, n_parts, -1)), n_parts)


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and 3 or more, from the numbers of grams counted 1 to 4 times."""
    if not (n1 and n2 and n3 and n4):
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    raw = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.clip(raw, [0, 0.01, 0.01, 0.01], [0, 0.99, 1.99, 2.99])


def estimate(grams: np.ndarray, counts: np.ndarray, cut: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Probability of each gram's last byte after its context; below has that of its suffix."""
    d = cut[np.minimum(counts, 3)]
    context = grams >> BITS
    order = np.argsort(context, kind="stable")
    at = np.empty(len(grams), np.int64)
    at[order] = np.cumsum(np.concatenate(([0], context[order][1:] != context[order][:-1])))
    whole = np.bincount(at, counts)
    return (counts - d) / whole[at] + (np.bincount(at, d) / whole)[at] * below


def escapes(grams: np.ndarray, counts: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted contexts and the weight that each leaves to the order below."""
    context, at = np.unique(grams >> BITS, return_inverse=True)
    return context, np.bincount(at, cut[np.minimum(counts, 3)], len(context)) / np.bincount(at, counts, len(context))


def low_orders(pairs: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Probability of the last byte of each pair of bytes after the first, by pair."""
    (one, n_one), (two, n_two) = levels(pairs, follows, 1)
    p = np.full(1 << BITS, 1 / (1 << BITS))
    if len(one):
        cut = discounts(*counts_of_counts(n_one))
        seen = estimate(one, n_one, cut, p[one])
        p *= escapes(one, n_one, cut)[1]
        p[one] = seen
    cut = discounts(*counts_of_counts(n_two))
    left = np.ones(1 << BITS)
    context, weight = escapes(two, n_two, cut)
    left[context] = weight
    out = (left[:, None] * p[None, :]).ravel()
    out[two] = estimate(two, n_two, cut, p[two & 0xFF])
    return out


def _tag(kind: int, order: int, grams: np.ndarray) -> np.ndarray:
    """Places of a block's lower table: grams of an order (kind 0) and the contexts of grams of an order (kind 1)."""
    return grams | (kind << 4 | order) << (BITS * ORDER)


def _logs(p: np.ndarray) -> np.ndarray:
    return np.round(np.log(p) * SCALE).astype(np.int32)


def train(parts: DataFrame) -> DataFrame:
    """MODEL: for each part its sorted grams and their log probabilities, times SCALE and rounded, and its lower table; at -1 the logs of all pairs."""
    orders = range(LOW + 1, ORDER + 1)
    seen = parts.select(*[F.sum(F.col("seen")[i]).cast("double") for i in range(4 * len(orders))]).first()
    cuts = [discounts(*[x or 0.0 for x in seen[4 * i : 4 * i + 4]]) for i in range(len(orders))]
    both = parts.select(F.explode(F.arrays_zip("pairs", "follows")).alias("x")).groupBy("x.pairs").agg(F.sum("x.follows").alias("n"))
    low = both.toArrow().sort_by("pairs")  # at most 2**16 rows
    base = low_orders(low["pairs"].to_numpy().astype(np.int64), low["n"].to_numpy())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams, counts = (np.frombuffer(row[c], np.int64) for c in ("grams", "counts"))
                p, above, tags, values = base, None, [], []
                for order, cut, (g, n) in zip(orders, cuts, levels(grams, counts, LOW + 1), strict=True):
                    suffix = g & ((1 << (BITS * (order - 1))) - 1)
                    p = estimate(g, n, cut, p[suffix] if above is None else p[np.searchsorted(above, suffix)])
                    above = g
                    if order < ORDER:
                        tags.append(_tag(0, order, g))
                        values.append(_logs(p))
                    context, weight = escapes(g, n, cut)
                    tags.append(_tag(1, order, context))
                    values.append(_logs(weight))
                held = [row["grams"], _logs(p).tobytes(), np.concatenate(tags).tobytes(), np.concatenate(values).tobytes()]
                size = row["size"] + sum(map(len, tags))
                yield pa.RecordBatch.from_arrays([pa.array([row["at"]]), pa.array([size]), *[pa.array([x], pa.binary()) for x in held]], ["at", "size", "grams", "logs", "lower", "lower_logs"])

    pairs = parts.sparkSession.createDataFrame([(-1, 0, b"", bytearray(_logs(base).tobytes()), b"", b"")], MODEL)
    return parts.select("at", "size", "grams", "counts").mapInArrow(of, MODEL).unionByName(pairs)


class Model(list):
    """Broadcast blocks of six-grams; lower has for each which keys it holds and its broadcast lower table, pairs the logs of all pairs of bytes."""

    def __init__(self, pairs: np.ndarray):
        super().__init__()
        self.pairs, self.lower = pairs, []

    def drop(self) -> None:
        for x in [*self, *[x for _, x in self.lower]]:
            x.destroy()


def share(model: DataFrame) -> Model:
    """The model as broadcast blocks of sorted arrays; the driver holds one block at a time (a part is at most one key larger than PART_GRAMS)."""
    sizes = model.select("at", "size").where("at >= 0").orderBy("at").collect()  # at most 2**16 rows
    out, begin = Model(np.frombuffer(model.where("at = -1").first()["logs"], np.int32).astype(np.int64)), 0
    context = model.sparkSession.sparkContext
    while begin < len(sizes):
        end, n = begin, 0
        while end < len(sizes) and (end == begin or n + sizes[end][1] <= BLOCK_GRAMS):
            n += sizes[end][1]
            end += 1
        got = model.where(F.col("at").between(sizes[begin][0], sizes[end - 1][0])).select("grams", "logs", "lower", "lower_logs").toArrow()
        tables = []
        for keys, values in (("grams", "logs"), ("lower", "lower_logs")):
            keys, values = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in got[c]]) for c, kind in ((keys, np.int64), (values, np.int32)))
            order = np.argsort(keys)
            tables.append((keys[order], values[order]))
        out.append(context.broadcast(tables[0]))
        holds = np.zeros(1 << (BITS * LOW), bool)
        holds[_key(tables[0][0])] = True
        out.lower.append((holds, context.broadcast(tables[1])))
        begin = end
    return out


def _place(known: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in sorted, not empty values, and whether they are there."""
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return at, known[at] == x


def _has(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _place(known, x)[1]


def _let_go(block: Broadcast, n: int) -> None:
    """Of more blocks than RESIDENT, each is read again from the executor's copy for the next group."""
    if n > RESIDENT and getattr(block, "_path", None):
        vars(block).pop("_value", None)


def _back_off(grams: np.ndarray, value: np.ndarray, known: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Logs of grams that the model lacks, from those of their last pairs: the longest suffix in the lower table, and the weights of longer contexts."""
    for order in range(LOW + 1, ORDER + 1):
        suffix = grams & ((1 << (BITS * order)) - 1)
        at, there = _place(known, _tag(1, order, suffix >> BITS))
        value = np.where(there, value + logs[at], value)
        if order < ORDER:
            at, there = _place(known, _tag(0, order, suffix))
            value = np.where(there, logs[at], value)
    return value


def _pieces(rows: K.Rows) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose numbers have ROW_BITS bits."""
    for at in range(0, rows.n, 1 << ROW_BITS):
        yield at, min(rows.n, at + (1 << ROW_BITS))


def _log_sums(group: list[K.Rows], model: Model) -> list[np.ndarray]:
    """Sums of the log probabilities of each row's grams, by block of rows. Grams are sorted with their rows' numbers below them."""
    found = []
    for rows in group:
        c = codes(rows)
        for begin, end in _pieces(rows):
            bounds = rows.bounds[begin : end + 1]
            both = c[bounds[0] : bounds[-1]].view(np.uint64) << np.uint64(ROW_BITS)
            both |= np.repeat(np.arange(end - begin, dtype=np.uint64), np.diff(bounds))
            both.sort()
            grams = (both >> np.uint64(ROW_BITS)).view(np.int64)
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(grams)), bool), grams[1:] != grams[:-1])))
            times = np.diff(np.append(first, len(grams)))
            grams = grams[first]
            row = (both & np.uint64((1 << ROW_BITS) - 1)).astype(np.uint16)
            found.append((grams, times, row, model.pairs[grams & ((1 << (BITS * LOW)) - 1)], _key(grams)))
    for block, (holds, lower) in zip(model, model.lower, strict=True):
        known, logs = block.value
        for grams, _, _, value, key in found:
            own = np.flatnonzero(holds[key])
            at, there = _place(known, grams[own])
            value[own[there]] = logs[at[there]]
            lacks = own[~there]
            value[lacks] = _back_off(grams[lacks], value[lacks], *lower.value)
        _let_go(block, len(model))
        _let_go(lower, len(model))
    each = iter(found)
    out = []
    for rows in group:
        sums = [np.empty(0, np.int64)]
        for begin, end in _pieces(rows):
            _, times, row, value, _ = next(each)
            sums.append(np.bincount(row, np.repeat(value, times), end - begin).astype(np.int64))  # whole numbers, far below 2**53
        out.append(np.concatenate(sums))
    return out


def _held_out_sums(group: list[Words], models: tuple[Model, Model], wanted: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of the log probabilities of each wanted row's grams, by the model of its fold; 0 for other rows."""
    out = [np.zeros(words.rows.n, np.int64) for words in group]
    folds = [np.where(want, fold_of(words), -1) for words, want in zip(group, wanted, strict=True)]
    for i, model in enumerate(models):
        part = [K.pick(words.rows, fold == i) for words, fold in zip(group, folds, strict=True)]
        for x, fold, got in zip(out, folds, _log_sums(part, model), strict=True):
            x[fold == i] = got
    return out


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def _count(member: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Members of each row."""
    return np.diff(K.row_of(np.flatnonzero(member), bounds))


def word_stats(words: Words) -> dict[str, np.ndarray]:
    """What base_failed needs, for each row."""
    at, row = K.within(words.bounds, 3)
    grams = K.windows(words.each, 3)
    grams = K.mix(grams[at] + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = at[_repeated(grams)]
    covered = np.zeros(len(words.starts) + 3, bool)
    for j in range(3):
        covered[at + j] = True
    return {"n_words": np.diff(words.bounds), "n_repeat_words": _count(covered[: len(words.starts)], words.bounds)}


def base_stats(words: Words) -> dict[str, np.ndarray]:
    """The counts of the base rules for each row."""
    data, bounds = words.rows.data, words.rows.bounds
    line_starts, line_ends = K.runs(data != 10, bounds)
    real = np.searchsorted(words.starts, line_ends) > np.searchsorted(words.starts, line_starts)
    line_starts, line_ends = line_starts[real], line_ends[real]
    lines = K.span_hash(words.hashes, line_starts, line_ends)
    line_row = np.searchsorted(bounds, line_starts, "right") - 1
    lines = K.mix(lines + line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(lines, kind="stable")
    again = np.zeros(len(lines), bool)
    again[order[1:]] = lines[order[1:]] == lines[order[:-1]]
    return word_stats(words) | {
        "word_chars": _count(words.bytes & ((data & 0xC0) != 0x80), bounds),
        "n_symbols": _count(SYMBOL[data], bounds),
        "n_dup_lines": np.bincount(line_row[again], minlength=words.rows.n).astype(np.int64),
    }


def _repeated(h: np.ndarray) -> np.ndarray:
    """True where a value occurs twice or more."""
    order = np.argsort(h)
    h = h[order]
    same = h[1:] == h[:-1]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def score(docs: DataFrame, model: Model | tuple[Model, Model], keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns keep of docs, with the base counts, base_failed and log_ppl, by one model or by that of each fold."""
    names = [x.split()[0] for x in STATS.split(", ")]
    docs = docs.select(*[c for c in keep if c not in names], docs[text_col].alias("_text"))
    kept = docs.columns[:-1]
    schema = docs.drop("_text").schema
    for x in STATS.split(", "):
        schema = schema.add(*x.split())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[np.ndarray]] = {c: [] for c in names}
            for group in batched(K.blocks(batch.column(len(kept))), _group(model)):
                read = [Words(rows) for rows in group]
                sums = _held_out_sums(read, model, [np.ones(w.rows.n, bool) for w in read]) if isinstance(model, tuple) else _log_sums(list(group), model)
                for words, logs in zip(read, sums, strict=True):
                    s = base_stats(words)
                    s["base_failed"] = base_failed(s)
                    s["log_ppl"] = _per_byte(words, logs)
                    for c in names:
                        found[c].append(s[c])
            cols = [np.concatenate(found[c]) if found[c] else np.empty(0) for c in names]
            arrays = [pa.array(v, pa.float64(), mask=np.isnan(v)) if c == "log_ppl" else pa.array(v, pa.bool_() if c == "base_failed" else pa.int64()) for c, v in zip(names, cols, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], *arrays], [*kept, *names])

    return docs.mapInArrow(of, schema)


def _group(model: Model | tuple[Model, Model]) -> int:
    """Blocks of rows that read a model together: more than one where its blocks are not all held."""
    return 1 if max(map(len, model if isinstance(model, tuple) else [model])) <= RESIDENT else 16


def _per_byte(words: Words, logs: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.round(np.where(np.diff(words.bounds) > 0, -logs / SCALE / np.diff(words.rows.bounds), np.nan), 9)


def score_passing(docs: DataFrame, models: tuple[Model, Model], lang_col: str, text_col: str) -> DataFrame:
    """(_lang_of, log_ppl, _mark) of the documents that pass the base rules: language, score by the model of the fold, hash of the text."""
    docs = docs.select(F.col(lang_col).alias("_lang_of"), F.col(text_col).alias("_text"))
    schema = docs.drop("_text").schema.add("log_ppl", "double").add("_mark", "long")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batched(K.blocks(batch.column(1)), _group(models)):
                read = [Words(rows) for rows in group]
                passing = [~base_failed(word_stats(words)) for words in read]
                for words, want, logs in zip(read, passing, _held_out_sums(read, models, passing), strict=True):
                    at = np.flatnonzero(want)
                    lang = batch.column(0).slice(words.rows.first, words.rows.n).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([lang, pa.array(_per_byte(words, logs)[at]), pa.array(marks(words.rows, words.hashes)[at])], ["_lang_of", "log_ppl", "_mark"])

    return docs.mapInArrow(of, schema)


def bands(scored: DataFrame, lang_col: str = "lang", width: float = WIDTH, floor: float = FLOOR, least: int = LEAST) -> DataFrame:
    """(lang, low, high) of log perplexity, for languages with enough documents that pass the base rules."""
    if "base_failed" in scored.columns:
        scored = scored.where("NOT base_failed")
    bins = scored.where("log_ppl IS NOT NULL").groupBy(F.col(lang_col).alias("_lang"), F.floor(F.col("log_ppl") * 1000).alias("bin")).count()
    w = Window.partitionBy("_lang").orderBy("bin")
    up = bins.withColumn("upto", F.sum("count").over(w)).withColumn("all", F.sum("count").over(Window.partitionBy("_lang")))
    q = lambda p: F.min(F.when(F.col("upto") >= F.col("all") * p, F.col("bin"))) / 1000
    out = up.groupBy("_lang").agg(F.max("all").alias("n"), q(0.25).alias("q1"), q(0.75).alias("q3")).where(F.col("n") >= least)
    spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(floor)) * width
    return out.select("_lang", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))


def _banded(scored: DataFrame, band: DataFrame, lang_col: str) -> DataFrame:
    """scored with the low and high of its language, null where it has none, and inside."""
    same = F.col(lang_col).eqNullSafe(F.col("_lang"))
    few = len(band.select("_lang").take(4097)) <= 4096  # a language tag is a short string: a checked, small broadcast
    out = scored.join(F.broadcast(band) if few else band, same, "left").drop("_lang")
    return out.withColumn("inside", F.col("low").isNull() | F.col("log_ppl").between(F.col("low"), F.col("high")))


def _share_marks(found: DataFrame) -> list[Broadcast]:
    """The different _mark of found as broadcast sorted arrays of about HELD_MARKS."""
    found = stash(found.select("_mark").distinct(), "marks")
    n = found.count()
    blocks = -(-n // HELD_MARKS)
    each = (found.where(F.pmod("_mark", F.lit(blocks)) == i).toArrow()["_mark"].to_numpy() for i in range(blocks))
    return [found.sparkSession.sparkContext.broadcast(np.sort(x)) for x in each if len(x)]


def held_out_models(parts: DataFrame) -> tuple[Model, Model]:
    """For each fold the model of the other one."""
    zero, one = (share(stash(train(parts.where(F.shiftright("at", BITS * LOW) == 1 - fold)), "model")) for fold in (0, 1))
    return zero, one


def with_quality(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text", lang_col: str = "lang", width: float = WIDTH) -> DataFrame:
    """docs (or their columns keep) with the base counts, log_ppl, the band's low and high, and kept."""
    keep = docs.columns if keep is None else keep
    both = list(dict.fromkeys([*keep, lang_col]))
    n_parts = _n_parts(docs, text_col)
    counted = stash(count_ngrams(docs, text_col, True, n_parts), "grams")
    models = held_out_models(counted)
    for _ in range(ROUNDS - 1):
        rough = stash(score_passing(docs, models, lang_col, text_col), "rough")
        near = _banded(rough, stash(bands(rough, "_lang_of", TRIM, 0.0), "bands"), "_lang_of")
        left_out = _share_marks(near.where("NOT inside"))
        for x in models:
            x.drop()
        parts = leave_out(counted, docs, left_out, text_col, n_parts)
        models = held_out_models(stash(parts, "grams") if left_out else counted)
        for x in left_out:
            x.destroy()
    scored = stash(score(docs, models, both, text_col), "quality")
    band = stash(bands(scored, lang_col, width), "bands")
    out = _banded(scored, band, lang_col)
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("inside")).drop("inside")
    return out if lang_col in keep else out.drop(lang_col)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"), ["doc_id"])


QUERIES = {"op7_quality": (op7_quality, None)}
