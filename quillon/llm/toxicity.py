"""6. Toxicity: cumulative-link ordinal regression over sparse text features.

P(grade >= k) = sigmoid(w.x - theta_k): all thresholds share the weights w, and theta is increasing. x marks which of the
selected words a whole text has (digits, letters and non-ASCII characters, A-Z lower-cased; hashed to 64 bits, kept as a
sorted array). The expected severity is the sum of P(grade >= k) over k. A document is rejected if P(grade >= 1) reaches a
threshold that is fitted on a held-out fifth of the sample (best F1).

Grades: an integer label of 0 to K is used as it is. A label of only 0 and 1 is refined to 0, 1 and 2: among the labelled
toxic documents, those with more different words that are strongly tied to the toxic label than their median get grade 2.

Fitting takes a bounded sample: at most about ``per`` labelled documents of each label (by a hash of the id), weighted
back to their label's share. Scoring covers every document and whole texts.

Edge cases: a null or wordless text has no features and the severity of the baseline, and is never rejected; null labels
and labels of unknown documents are not used; repeated rows count each; without labels of both kinds nothing is
rejected and the severity is 0; an empty table gives no rows. Extra columns stay; ``severity p_toxic grade rejected``
overwrite columns of these names.
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

PER = 3000
FEATURES = 4096
MIN_DF = 4
CHI2 = 25.0
ROUNDS = 400


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    theta: np.ndarray
    cut: float


def word_sets(rows: K.Rows) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes of each row, sorted in a row, and the row of each."""
    low = K.LOWER[rows.data]
    starts, ends = K.runs(K.ALNUM[low], rows.bounds)
    h = K.span_hash(K.prefix(low), starts, ends)
    row = np.searchsorted(rows.bounds, starts, "right") - 1
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def fit(sets: list[np.ndarray], label: np.ndarray, weight: np.ndarray, features: int = FEATURES, rounds: int = ROUNDS) -> Model:
    """sets: word hashes of each labelled document; label: whole numbers from 0."""
    empty = Model(np.empty(0, np.uint64), np.empty(0), np.zeros(0), 2.0)
    if not len(label) or label.max() < 1 or label.min() > 0:
        return empty
    toxic = label > 0
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    words, at = np.unique(np.concatenate(sets), return_inverse=True)
    a = np.bincount(at, toxic[owner], minlength=len(words))
    b = np.bincount(at, minlength=len(words)) - a
    n1, n0 = toxic.sum(), (~toxic).sum()
    with np.errstate(all="ignore"):
        chi2 = np.nan_to_num((a * (n0 - b) - b * (n1 - a)) ** 2 * (n1 + n0) / ((a + b) * (n1 + n0 - a - b) * n1 * n0.astype(float)))
    chosen = np.flatnonzero((a + b >= MIN_DF) & (chi2 >= CHI2))
    chosen = np.sort(chosen[np.argsort(-chi2[chosen], kind="stable")[:features]])
    if not len(chosen):
        return empty
    number = np.full(len(words), -1)
    number[chosen] = np.arange(len(chosen))
    col, row = number[at], owner
    col, row = col[col >= 0], row[col >= 0]
    if label.max() == 1:
        strong = (a[chosen] * n0 > 8 * (b[chosen] + 0.5) * n1)
        many = np.bincount(row, strong[col], minlength=len(label))
        label = toxic + (toxic & (many > np.median(many[toxic]))).astype(int)
    grades = int(label.max())
    fold = np.arange(len(label)) % 5
    train = fold != 0
    w, theta = np.zeros(len(chosen)), np.linspace(1, 2, grades)
    gap = np.concatenate((theta[:1], np.log(np.diff(theta))))
    use = train[row]
    tr_row, tr_col = row[use], col[use]
    sw = np.where(train, weight, 0)
    sw = sw / sw.sum()
    m = [np.zeros(len(w) + grades), np.zeros(len(w) + grades)]
    k = np.arange(1, grades + 1)

    def thresholds(g: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate((g[:1], np.exp(g[1:]))))

    for step in range(1, rounds + 1):
        theta = thresholds(gap)
        z = np.bincount(tr_row, w[tr_col], minlength=len(label))
        p = 1 / (1 + np.exp(np.clip(theta - z[:, None], -40, 40)))  # P(grade >= k)
        full = np.concatenate((np.ones((len(label), 1)), p, np.zeros((len(label), 1))), 1)
        own = np.maximum(full[np.arange(len(label)), label] - full[np.arange(len(label)), label + 1], 1e-12)
        slope = p * (1 - p)
        up = np.where(label[:, None] == k, slope, 0) - np.where(label[:, None] + 1 == k, slope, 0)  # d own / d (z - theta_k)
        g = -(sw / own)[:, None] * up
        g_theta = -g.sum(0)
        g_gap = np.cumsum(g_theta[::-1])[::-1].copy()
        g_gap[1:] *= np.exp(gap[1:])
        g_w = np.bincount(tr_col, g.sum(1)[tr_row], minlength=len(w)) + 1e-4 * w
        grad = np.concatenate((g_w, g_gap))
        m[0] = 0.9 * m[0] + 0.1 * grad
        m[1] = 0.99 * m[1] + 0.01 * grad**2
        move = 0.1 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-9)
        w, gap = w - move[: len(w)], gap - move[len(w) :]
    theta = thresholds(gap)
    z = np.bincount(row, w[col], minlength=len(label))
    held = ~train if (~train & toxic).any() else train
    p1 = 1 / (1 + np.exp(theta[0] - z[held]))
    order = np.argsort(-p1, kind="stable")
    hit = np.cumsum((weight[held] * toxic[held])[order])
    all_ = np.cumsum(weight[held][order])
    f1 = 2 * hit / (all_ + hit[-1])
    f1[:-1][p1[order][:-1] == p1[order][1:]] = 0  # a cut falls between different values only
    best = int(np.argmax(f1))
    cut = (p1[order][best] + (p1[order][best + 1] if best + 1 < len(order) else 0)) / 2
    return Model(words[chosen], w, theta, float(max(cut, np.nextafter(1 / (1 + np.exp(theta[0])), 1))))


def train(docs: DataFrame, labels: DataFrame, per: int = PER, label_col: str = "toxic") -> Model:
    """A model from at most about per documents of each label. A label of 1 or more counts as toxic, any other number as harmless, null as no label."""
    known = labels.where("doc_id IS NOT NULL").select("doc_id", (F.col(label_col).cast("double") >= 1).cast("int").alias("_y")).where("_y IS NOT NULL")
    sizes = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    few = F.broadcast(stratified(known, "_y", "doc_id", per))  # at most about per rows a label

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in K.blocks(batch.column(2)):
                h, row = word_sets(rows)
                offsets = np.searchsorted(row, np.arange(rows.n + 1)).astype(np.int32)
                part = [batch.column(k).slice(rows.first, rows.n) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part, pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))], ["doc_id", "y", "words"])

    got = K.mapped(docs.select("doc_id", "text").join(few, "doc_id").select("doc_id", "_y", "text"), sets, "doc_id long, y int, words array<bigint>")
    table = got.toArrow().combine_chunks()
    ids = table["doc_id"].to_numpy()
    pick = np.unique(ids, return_index=True)[1]  # one row an id, in the order of ids
    label = table["y"].to_numpy()[pick].astype(np.int64)
    taken = np.bincount(label) if len(label) else np.empty(0)
    weight = np.array([sizes[y] / taken[y] for y in label.tolist()])
    model = fit([table["words"][i].values.to_numpy().view(np.uint64) for i in pick.tolist()], label, weight)
    del table
    K.trim()  # the driver's
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs (or their columns keep) with severity, p_toxic, grade (the likeliest) and rejected, each name after a prefix."""
    added = [prefix + c for c in ("severity", "p_toxic", "grade", "rejected")]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rows_ = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = docs.select(*keep).schema
    for c, kind in zip(added, ("double", "double", "integer", "boolean"), strict=True):
        schema = schema.add(c, kind)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            zs, some = [np.empty(0)], [np.empty(0, bool)]
            for rows in K.blocks(batch.column(len(keep))):
                z = np.zeros(rows.n)
                words = np.zeros(rows.n, bool)
                if len(m.words):
                    h, row = word_sets(rows)
                    at = np.minimum(np.searchsorted(m.words, h), len(m.words) - 1)
                    hit = m.words[at] == h
                    z = np.bincount(row[hit], m.weights[at[hit]], minlength=rows.n)
                    words[row] = True
                zs.append(z)
                some.append(words)
            z, words = np.concatenate(zs), np.concatenate(some)
            p = 1 / (1 + np.exp(np.clip(m.theta - z[:, None], -40, 40))) if len(m.theta) else np.zeros((len(z), 1))
            p = np.round(p, 9)
            full = np.concatenate((np.ones((len(z), 1)), p, np.zeros((len(z), 1))), 1)
            cols = [pa.array(p.sum(1).round(9)), pa.array(p[:, 0]), pa.array((full[:, :-1] - full[:, 1:]).argmax(1).astype(np.int32)), pa.array(words & (p[:, 0] >= m.cut))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *cols], schema.names)

    return K.mapped(rows_, of, schema)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rejected ones; their columns stay as they are, whatever their names."""
    return score(docs, model, text_col=text_col, prefix="_quillon_").where("NOT _quillon_rejected").select(*docs.columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), ["doc_id"])


QUERIES = {"op6_toxicity": (op6_toxicity, None)}
