"""10. Secret scans: a character convolutional network over every candidate and its context.

Base findings are three patterns (``assign``, ``access``, ``hex``). Candidates are the base findings and every other run
of 16 or more token characters with both a letter and a digit. A network in numpy (character embedding, one convolution,
maximum over places, logistic output) reads each candidate in windows of ``SPAN`` characters, with ``BEFORE`` characters
before it and ``AFTER`` behind it; a long candidate is read whole, and its best window counts.

It is trained on labelled findings only, those of all documents: the base findings (secrets) and runs that stand in a mail
address or URL (harmless); what else the texts hold has no label and trains nothing. Seeded findings of further shapes of
secrets and of harmless tokens are added. The distinct findings are dealt by hash to shares of about ``SHARE``; in each
round every share, with the seeded findings, moves the network for one epoch, and the driver takes the mean of the shares'
networks. A held-out fifth of all shares calibrates the score (Platt scaling) and fixes the threshold: the greatest score
(in steps of a thousandth of a logit) that keeps at least ``RECALL`` of the held-out secrets, both of those in the documents
and of the seeded ones, which many findings of the base shapes would outvote. Every candidate gets a score. Those outside the base findings that reach the threshold are added as kind ``model``; base findings stay, whatever
their score.

Positions are code points, ends exclusive. Edge cases: null is empty and has no findings; repeated rows count each; an
empty table gives no rows; with no labelled documents the seeded findings alone train the network. Extra columns stay in
``scan``; ``findings`` overwrites a column of that name.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import drop, stash

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?=[+/_.=0-9-]*[A-Za-z])(?=[+/_.=A-Za-z-]*[0-9])[A-Za-z0-9+/_.=-]{16,}")
#: Cheap tests of a whole column, for texts that may have a finding of each pattern.
MAYBE = (r"(?i)(?:password|passwd|secret|token|api_?key)", "AKIA", r"[0-9a-f]{32}", r"[A-Za-z0-9+/_.=-]{16}")
BEFORE, SPAN, AFTER = 24, 48, 8
WIDTH = BEFORE + SPAN + AFTER
CHARS, DIM, KERNEL, FILTERS = 98, 8, 5, 24
RECALL = 0.95
SHARE = 8192  # findings of a share, about
SEEDED = 1500
EPOCHS = 12


def base_findings(text: str, maybe: tuple[bool, bool, bool] = (True, True, True)) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind."""
    out = []
    if maybe[0]:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if maybe[1]:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if maybe[2]:
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def other_candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Token runs that no base finding touches."""
    out, k = [], 0
    spans = sorted((a, b) for a, b, _ in base)
    for m in TOKEN.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        if not any(a < m.end() and m.start() < b for a, b in spans[max(0, k - 1) : k + 3]):
            out.append((m.start(), m.end()))
    return out


def known_harmless(text: str, start: int) -> bool:
    """Whether the run is the host of a mail address or part of a URL."""
    lead = re.search(r"\S*$", text[max(0, start - 200) : start])[0]
    return lead.endswith("@") or "://" in lead


def _code(c: str) -> int:
    n = ord(c)
    return n - 31 if 32 <= n < 127 else 96 if n in (9, 10, 13) else 97


def encode(text: str, start: int, end: int) -> list[list[int]]:
    """One row of character codes for each window of the candidate; 0 pads."""
    rows = []
    for at in range(start, max(end, start + 1), SPAN):
        to = min(end, at + SPAN)
        before = [_code(c) for c in text[max(0, at - BEFORE) : at]]
        body = [_code(c) for c in text[at:to]]
        after = [_code(c) for c in text[to : to + AFTER]]
        rows.append([0] * (BEFORE - len(before)) + before + body + [0] * (SPAN - len(body)) + after + [0] * (AFTER - len(after)))
    return rows


@dataclass
class Model:
    embedding: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    shift: float = 0.0
    cut: float = 1.1

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = self.embedding[x]
        cols = np.lib.stride_tricks.sliding_window_view(e, KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - KERNEL + 1, KERNEL * DIM)
        z = cols @ self.conv + self.bias
        return cols, z, z.max(1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        parts = [np.maximum(self.hidden(x[i : i + 256])[2], 0) @ self.out + self.out_bias for i in range(0, len(x), 256)]
        return np.concatenate(parts) if parts else np.empty(0)

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -40, 40)))


def seeded(n: int, seed: int = 3) -> tuple[list[list[int]], list[int]]:
    """Labelled findings of further shapes: n secrets and n harmless tokens, in a context of random words."""
    rng = np.random.default_rng(seed)
    low, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    of = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    word = lambda: of("aeiou" + low, int(rng.integers(3, 9)))
    secrets = (
        lambda: of("abcdef" + digit, int(rng.integers(24, 65))),
        lambda: of(upper + low + digit, int(rng.integers(20, 44))),
        lambda: of(upper + low + digit + "+/", int(rng.integers(28, 60))) + "==",
        lambda: pick(("ghp_", "gho_", "sk_live_", "xoxb-", "glpat-", "npm_")) + of(upper + low + digit, 32),
        lambda: "eyJ" + of(upper + low + digit, 24) + ".eyJ" + of(upper + low + digit, 30) + "." + of(upper + low + digit + "-_", 30),
        lambda: of("ABCDEF" + digit, 40),
    )
    harmless = (
        lambda: of(digit, int(rng.integers(16, 24))) + "a",
        lambda: f"{word()}.{int(rng.integers(100))}@mail{int(rng.integers(9))}.example.com".replace("@", "."),
        lambda: f"{word()}-{word()}-{word()}-{int(rng.integers(2000))}",
        lambda: f"{word()}_{word()}_v{int(rng.integers(9))}.{word()}",
        lambda: f"{word()}/{word()}/{word()}{int(rng.integers(99))}/{word()}.html",
        lambda: f"{word().upper()}-{int(rng.integers(1e6))}-{word().upper()}",
        lambda: f"20{int(rng.integers(10, 30))}-0{int(rng.integers(1, 9))}-1{int(rng.integers(9))}T{int(rng.integers(10, 23))}.{of(digit, 6)}",
        lambda: word() + word() + word() + of(digit, 2),
    )
    lead = ("token = \"", "key: ", "Bearer ", "secret=", "", " ", "the ", "auth ")
    rows, labels = [], []
    for i in range(2 * n):
        body = pick(secrets)() if i % 2 else pick(harmless)()
        text = f"{word()} {word()} {pick(lead) if i % 2 or rng.random() < 0.3 else ''}"
        got = encode(text + body + " " + word(), len(text), len(text) + len(body))
        rows += got
        labels += [i % 2] * len(got)
    return rows, labels


PARTS = ("embedding", "conv", "bias", "out", "out_bias")


def fresh(rng: np.random.Generator) -> Model:
    return Model(rng.normal(0, 0.3, (CHARS, DIM)).astype(np.float32), rng.normal(0, 0.15, (KERNEL * DIM, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, FILTERS).astype(np.float32), 0.0)


def epoch(m: Model, state: dict[str, list[np.ndarray]], step: int, x: np.ndarray, y: np.ndarray, order: np.ndarray) -> int:
    """Moves m and the moments of its gradients (Adam) over x and y in batches of the given order; the number of steps so far."""
    for at in range(0, len(order), 64):
        step += 1
        idx = order[at : at + 64]
        cols, z, top = m.hidden(x[idx])
        h = np.maximum(top, 0)
        p = 1 / (1 + np.exp(-np.clip(h @ m.out + m.out_bias, -40, 40)))
        g = ((p - y[idx]) / len(idx)).astype(np.float32)
        g_top = np.outer(g, m.out) * (top > 0)
        best = z.argmax(1)
        n = np.arange(len(idx))
        picked = cols[n[:, None], best]  # (batch, filter, kernel * dim)
        g_conv = np.einsum("bf,bfk->kf", g_top, picked)
        g_cols = g_top[:, :, None] * m.conv.T[None]
        g_emb = np.zeros_like(m.embedding)
        chars = x[idx][n[:, None, None], best[:, :, None] + np.arange(KERNEL)]
        np.add.at(g_emb, chars.ravel(), g_cols.reshape(-1, DIM))
        for name, grad in zip(PARTS, (g_emb, g_conv, g_top.sum(0), h.T @ g, g.sum()), strict=True):
            s = state.setdefault(name, [np.zeros_like(grad), np.zeros_like(grad)])
            s[0] = 0.9 * s[0] + 0.1 * grad
            s[1] = 0.999 * s[1] + 0.001 * grad**2
            setattr(m, name, getattr(m, name) - 0.005 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8))
    return step


GRID = [(slope, shift) for slope in np.geomspace(0.1, 3, 25).tolist() for shift in np.linspace(-3, 3, 25).tolist()]


def losses(z: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The summed loss of each slope and shift of GRID."""
    return np.array([float(np.sum(np.logaddexp(0, slope * z + shift) - want * (slope * z + shift))) for slope, shift in GRID])


def fit(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Model:
    """A model of findings at hand."""
    rng = np.random.default_rng(seed)
    m = fresh(rng)
    fold = rng.integers(0, 5, len(y))
    train, held = np.flatnonzero(fold != 0), np.flatnonzero(fold == 0)
    state: dict[str, list[np.ndarray]] = {}
    step = 0
    for _ in range(epochs):
        step = epoch(m, state, step, x, y, rng.permutation(train))
    z, want = m.logit(x[held]), y[held]
    m.slope, m.shift = GRID[int(np.argmin(losses(z, want)))]
    good = np.sort(m.probability(z[want == 1]))
    m.cut = float(good[int((1 - RECALL) * len(good))]) if len(good) else 1.1
    return m


def labelled(docs: DataFrame) -> DataFrame:
    """(x, y): the distinct encoded windows of all labelled findings of docs, a byte a character; 1 if any of them is a secret."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            maybe = list(zip(*(pc.fill_null(pc.match_substring_regex(column, x), False).to_pylist() for x in MAYBE), strict=True))
            found: dict[bytes, int] = {}
            for t, may in zip(column, maybe, strict=True):
                if not any(may):
                    continue
                text = t.as_py()
                base = base_findings(text, may[:3])
                others = [(x, 0) for x in other_candidates(text, base) if known_harmless(text, x[0])] if may[3] else []
                for (a, b), y in [((a, b), 1) for a, b, _ in base] + others:
                    for r in encode(text, a, b):
                        found[bytes(r)] = max(y, found.get(bytes(r), 0))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int32())], ["x", "y"])

    return docs.select("text").mapInArrow(of, "x binary, y int").groupBy("x").agg(F.max("y").alias("y"))


def _pack(m: Model, state: dict[str, list[np.ndarray]]) -> np.ndarray:
    zero = lambda k: [np.zeros_like(getattr(m, k))] * 2
    return np.concatenate([np.asarray(a, np.float64).ravel() for k in PARTS for a in (getattr(m, k), *state.get(k, zero(k)))])


def _unpack(flat: np.ndarray) -> tuple[Model, dict[str, list[np.ndarray]]]:
    m, state, at = fresh(np.random.default_rng(0)), {}, 0
    for k in PARTS:
        n, shape = np.size(getattr(m, k)), np.shape(getattr(m, k))
        a, b, c = (flat[at + i * n : at + (i + 1) * n].astype(np.float32).reshape(shape) for i in range(3))
        at += 3 * n
        setattr(m, k, a if shape else float(a))
        state[k] = [b, c]
    return m, state


def _held(x: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(r.tobytes()) % 5 == 0 for r in x.astype(np.uint8)], bool)


def train(docs: DataFrame, share: int = SHARE, epochs: int = EPOCHS, seed: int = 5) -> Model:
    """A model of the labelled findings of all docs, and seeded ones. Shares are fitted by the executors, and only networks reach the driver."""
    spark = docs.sparkSession
    found = stash(labelled(docs), "findings")
    n = found.count()
    more = seeded(SEEDED)
    more_x, more_y = np.array(more[0], np.int64), np.array(more[1], np.float32)
    if not n:
        drop(found)
        return fit(more_x, more_y, epochs, seed)
    parts = math.ceil(n / share)
    dealt = found.groupBy(F.pmod(F.xxhash64("x"), F.lit(parts)).cast("int").alias("share")).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("rows"))
    shares = stash(dealt, "shares")
    drop(found)
    more_held = _held(more_x)
    shared = spark.sparkContext.broadcast((more_x[~more_held].astype(np.uint8), more_y[~more_held]))

    def read(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(rows.values.field(0).to_pylist()), np.uint8).reshape(-1, WIDTH).astype(np.int64)
        return x, rows.values.field(1).to_numpy().astype(np.float32), _held(x)

    def each(of, schema: str) -> list:
        """What of makes of each share (its number and rows), in the order of shares."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (i, *of(i, *read(rows)))], [c.split()[0] for c in schema.split(", ")])

        return sorted(shares.mapInArrow(run, schema).collect(), key=lambda r: r[0])

    flat, step = _pack(fresh(np.random.default_rng(seed)), {}), 0
    for k in range(epochs):

        def move(i: int, x: np.ndarray, y: np.ndarray, held: np.ndarray, flat: np.ndarray = flat, step: int = step, k: int = k) -> tuple[int, int, bytes]:
            seed_x, seed_y = shared.value
            m, state = _unpack(flat)
            x, y = np.concatenate((seed_x.astype(np.int64), x[~held])), np.concatenate((seed_y, y[~held]))
            done = epoch(m, state, step, x, y, np.random.default_rng([seed, k, i]).permutation(len(y)))
            return len(y), done, _pack(m, state).tobytes()

        moved = each(move, "share long, n long, step long, flat binary")
        flat = sum(r["n"] * np.frombuffer(r["flat"]) for r in moved) / sum(r["n"] for r in moved)
        step = max(r["step"] for r in moved)
    m = _unpack(flat)[0]

    def judge(i: int, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> tuple[bytes, bytes, bytes]:
        z = m.logit(x[held])
        steps, count = np.unique(np.floor(z[y[held] == 1] * 1000).astype(np.int64), return_counts=True)
        return losses(z, y[held]).tobytes(), steps.tobytes(), count.astype(np.int64).tobytes()

    judged = [r[1:] for r in each(judge, "share long, losses binary, steps binary, n binary")] + [judge(-1, more_x[more_held], more_y[more_held], np.ones(int(more_held.sum()), bool))]
    drop(shares)
    m.slope, m.shift = GRID[int(np.argmin(sum(np.frombuffer(r[0]) for r in judged)))]
    cuts = []
    for group in (judged[:-1], judged[-1:]):
        steps, count = (np.concatenate([np.frombuffer(r[c], np.int64) for r in group]) for c in (1, 2))
        order = np.argsort(steps)
        below = np.cumsum(count[order])
        if len(below):
            at = int(np.searchsorted(below, int((1 - RECALL) * below[-1]), "right"))
            cuts.append(float(m.probability(steps[order][at] / 1000)))
    m.cut = min(cuts)
    return m


def scan(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """docs (or their columns keep) with findings: (start, end, kind, score), by start, then kind."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "findings"]
    kind = T.StructType().add("start", "long").add("end", "long").add("kind", "string").add("score", "double")
    schema = docs.select(*keep).schema.add("findings", T.ArrayType(kind))
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            column = batch.column(len(keep))
            maybe = list(zip(*(pc.fill_null(pc.match_substring_regex(column, x), False).to_pylist() for x in MAYBE), strict=True))
            out = []
            for t, may in zip(column, maybe, strict=True):
                if not any(may):
                    out.append([])
                    continue
                text = t.as_py()
                base = base_findings(text, may[:3])
                found = [*base, *((a, b, "model") for a, b in (other_candidates(text, base) if may[3] else []))]
                rows = [encode(text, a, b) for a, b, _ in found]
                p = m.probability(m.logit(np.array([r for x in rows for r in x]))) if rows else np.empty(0)
                at = np.cumsum([0, *map(len, rows)])
                scored = [(a, b, k, float(p[x:y].max())) for (a, b, k), x, y in zip(found, at[:-1], at[1:], strict=True)]
                found = [{"start": a, "end": b, "kind": k, "score": round(best, 6)} for a, b, k, best in scored if k != "model" or best >= m.cut]
                out.append(sorted(found, key=lambda f: (f["start"], KINDS.index(f["kind"]), f["end"])))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(out, arrow)], schema.names)

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(of, schema)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, train(docs), ["doc_id"])
    say = lambda rows: F.array_join(F.transform(rows, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    of = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    base = F.filter("findings", lambda f: f["kind"] != "model")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(say(base).cast("binary"), 256).alias("base_sha256"), say(F.col("findings")).alias("spans"), of("model").alias("n_model"))


QUERIES = {"op10_secrets": (op10_secrets, None)}
