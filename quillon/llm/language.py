"""4. Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

Subwords are the 3- and 4-byte strings of a text's letters (A-Z lower-cased, everything else ASCII becomes one kind of
space), hashed to ``BUCKETS`` rows of an embedding table. A text is the average of the embeddings of all its subwords; a
linear layer and a softmax give the language. Embeddings and layer are trained together by stochastic gradient descent
on a bounded sample of labelled rows (at most ``PER`` a language and ``MOST`` in all, texts of up to ``TRAIN_BYTES`` bytes),
of which a fifth is held out: it fits a temperature for the score and the score from which predictions are accepted
(the least with an accuracy of ``ACCEPT`` among the accepted). Prediction covers whole texts of every row.

Edge cases: a null text, or one without any letter, is ``und`` with score 0 and not accepted; rows with a null language
or text are not trained on; without labelled rows everything is ``und``; repeated rows count each; an empty table gives
no rows. Extra columns stay in ``predict``; ``lang_pred score accepted`` overwrite columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .sample import stratified

BUCKETS = 1 << 15
DIM = 16
PER = 500
MOST = 4000
TRAIN_BYTES = 1 << 16
EPOCHS = 6
ACCEPT = 0.995
_TEXT = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)], np.uint8)
_LETTER = K.lut(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)


@dataclass
class Model:
    langs: list[str]
    embedding: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    temperature: float
    accept: float


def subwords(rows: K.Rows) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the subwords that end at each byte: (2, bytes), -1 where there is none."""
    c = _TEXT[rows.data].astype(np.uint32)
    n = len(c)
    out = np.full((2, n), -1, np.int32)
    start = np.zeros(n, bool)
    start[rows.bounds[:-1][rows.bounds[:-1] < n]] = True
    code = c.copy()
    letter = (c != 0x20).astype(np.int8)
    has = letter.copy()
    crosses = np.zeros(n, bool)  # the string that ends here reaches before the row's start
    for k in range(1, 4):
        if n <= k:
            break
        crosses[k - 1 :] |= start[: n - k + 1]
        code[k:] = code[k:] + (c[:-k] << np.uint32(8 * k))
        has[k:] |= letter[:-k]
        if k >= 2:
            h = (code * np.uint32(0x9E3779B1) + np.uint32(k)) * np.uint32(0x85EBCA6B)
            ok = ~crosses & (has > 0)
            ok[:k] = False
            out[k - 2] = np.where(ok, (h >> np.uint32(17)).astype(np.int32), -1)
    return out


def has_letter(rows: K.Rows) -> np.ndarray:
    found = K.sums(_LETTER[rows.data], rows.bounds) > 0
    for i in np.flatnonzero(~found).tolist():
        text = rows.text(i)
        found[i] = any(c.isalpha() for c in text.decode("utf-8", "replace"))
    return found


def fit(bags: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, langs: list[str], seed: int = 7) -> Model:
    """bags: buckets and counts of each text."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w = np.zeros((DIM, len(langs)), np.float32)
    b = np.zeros(len(langs), np.float32)
    train = np.flatnonzero(np.arange(len(bags)) % 5 != 0)
    held = np.flatnonzero(np.arange(len(bags)) % 5 == 0)
    if len(bags) < 10:
        train = held = np.arange(len(bags))
    shares = [(x.astype(np.int64), (c / c.sum()).astype(np.float32)) for x, c in bags]
    for epoch in range(EPOCHS):
        rate = 2.0 * (1 - epoch / EPOCHS)
        for i in rng.permutation(train).tolist():
            at, share = shares[i]
            h = share @ e[at]
            z = h @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label[i]] -= 1
            back = w @ p
            w -= rate * np.outer(h, p)
            b -= 0.05 * rate * p
            e[at] -= rate * 30 * share[:, None] * back
    z = np.array([s @ e[at] @ w + b for at, s in (shares[i] for i in held.tolist())])
    want = label[held]
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 20, 60).tolist():
        q = z / t - (z / t).max(1, keepdims=True)
        loss = -(q[np.arange(len(want)), want] - np.log(np.exp(q).sum(1))).mean()
        best = min(best, (loss, t))
    t = best[1]
    q = np.exp(z / t - (z / t).max(1, keepdims=True))
    top, right = (q / q.sum(1, keepdims=True)).max(1), z.argmax(1) == want
    order = np.argsort(-top, kind="stable")
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= ACCEPT
    accept = float(top[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return Model(langs, e, w, b, t, accept)


def train(labelled: DataFrame, per: int = PER, most: int = MOST) -> Model | None:
    """labelled: rows (doc_id, text, lang) that may be learned from."""
    rows_ = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= TRAIN_BYTES)).select("doc_id", "lang", "text")
    langs = rows_.select("lang").distinct().limit(most).count()
    few = stratified(rows_, "lang", "doc_id", max(1, min(per, most // max(1, langs))))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in K.blocks(batch.column(2)):
                grams = subwords(rows)
                at, n = [], []
                for i in range(rows.n):
                    x = grams[:, rows.bounds[i] : rows.bounds[i + 1]].ravel()
                    u, c = np.unique(x[x >= 0], return_counts=True)
                    at.append(u.astype(np.int32))
                    n.append(c.astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.first, rows.n), batch.column(1).slice(rows.first, rows.n), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], ["doc_id", "lang", "at", "n"])

    got = few.mapInArrow(bags, "doc_id long, lang string, at array<int>, n array<int>").toArrow().combine_chunks().sort_by("doc_id")
    full = [i for i in range(len(got)) if len(got["at"][i])]
    if not full:
        return None
    langs_ = [got["lang"][i].as_py() for i in full]
    names = sorted(set(langs_))
    return fit([(got["at"][i].values.to_numpy(), got["n"][i].values.to_numpy()) for i in full], np.searchsorted(names, langs_), names)


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """docs (or their columns keep) with lang_pred, score and accepted."""
    added = ("lang_pred", "score", "accepted")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        # an average of embeddings times the layer is an average of (embedding times layer): whichever is narrower is summed
        folded = m is not None and len(m.langs) <= DIM
        table = None if m is None else (m.embedding @ m.layer if folded else m.embedding).astype(np.float64)
        if table is not None:
            table = np.ascontiguousarray(np.concatenate((table, np.zeros((1, table.shape[1])))).T)  # the last row is for -1
        for batch in batches:
            names, scores, accepted = [], [], []
            for rows in K.blocks(batch.column(len(keep))):
                letters = has_letter(rows)
                if m is None:
                    names += ["und"] * rows.n
                    scores += [0.0] * rows.n
                    accepted += [False] * rows.n
                    continue
                grams = subwords(rows)
                count = np.maximum(K.sums((grams >= 0).sum(0), rows.bounds), 1)
                z = np.stack([K.sums(t[grams[0]] + t[grams[1]], rows.bounds) for t in table], 1) / count[:, None]
                z = (z if folded else z @ m.layer) + m.bias
                q = z / m.temperature
                q = np.exp(q - q.max(1, keepdims=True))
                p = np.round(q.max(1) / q.sum(1), 9)
                best = z.argmax(1)
                names += [m.langs[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                scores += np.where(letters, p, 0.0).tolist()
                accepted += (letters & (p >= m.accept)).tolist()
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], schema.names)

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(of, schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4))
    model = train(docs.where(fold != 2))
    rows = docs.select("doc_id", (fold == 2).alias("held_out"), "text")
    return predict(rows, model, ["doc_id", "held_out"])


QUERIES = {"op4_language": (op4_language, None)}
