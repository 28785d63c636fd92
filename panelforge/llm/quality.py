"""Quality classifier: gated attention over the passages of a document.

Each passage (a window of bytes) is encoded as class and hashed-bigram frequencies; a
small network turns it into a hidden vector, gated attention weighs the passages, and the
weighted sum is scored.  Only document labels are learnt from.  The fit uses at most
`sample` labelled documents of at most `most` passages together: in the order of a hash of
their ids, those that still fit, whole; scoring reads every document whole.

Defined cases: a null or empty text is one passage of zeros and gets its score; labels
that are null count for nothing; without any label every score is 0.5, and with one class
only it nears that class; repeated rows score alike; long texts are scored in slices that
share one softmax, so memory does not grow with their length beyond one hidden row a passage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import Texts, hand_back, small_batches, text_chunks

PASSAGE, CLASSES, BIGRAMS, HIDDEN = 512, 64, 128, 24
WIDTH = CLASSES + BIGRAMS


def byte_classes() -> np.ndarray:
    """A class for each byte: letters by case, digits, white space, each ASCII sign, the rest."""
    out = np.zeros(256, np.int64)
    out[65:91], out[97:123], out[48:58] = 1, 2, 3
    out[9:14], out[10], out[32] = 4, 5, 6
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    out[signs] = 7 + np.arange(len(signs))
    out[128:192], out[192:] = 7 + len(signs), 8 + len(signs)
    return out


BYTE_CLASS = byte_classes()


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and each document's first passage (with the total last)."""
    t = Texts(column)
    lens = np.diff(t.offsets)
    count = np.maximum(1, -(-lens // PASSAGE))
    first = np.concatenate([[0], np.cumsum(count)])
    n = int(first[-1])
    where = np.arange(len(t.data)) - np.repeat(t.offsets[:-1], lens)
    where //= PASSAGE
    where += np.repeat(first[:-1], lens)
    kinds = np.bincount(where * CLASSES + BYTE_CLASS[t.data], minlength=n * CLASSES).reshape(n, CLASSES)
    d = t.data.astype(np.int64)
    if len(d) > 1:
        pair = ((d[:-1] * 40503 + d[1:] * 10007) >> 5) % BIGRAMS
        same = where[:-1] == where[1:]
        pairs = np.bincount((where[:-1] * BIGRAMS + pair)[same], minlength=n * BIGRAMS).reshape(n, BIGRAMS)
    else:
        pairs = np.zeros((n, BIGRAMS), np.int64)
    size = np.maximum(1, np.bincount(where, minlength=n))[:, None]
    return np.sqrt(np.hstack([kinds, pairs]) / size).astype(np.float32), first


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Attention:
    """h = tanh(Wx + b); a = softmax(u . tanh(Vh) * sigmoid(Gh)); score = sigmoid(c . sum(a h) + d)."""

    NAMES = ("W", "b", "V", "G", "u", "c", "d")

    def __init__(self, mean, scale, seed=7):
        r = np.random.default_rng(seed)
        k = HIDDEN
        self.mean, self.scale = mean, scale
        self.p = {"W": r.normal(0, len(mean) ** -0.5, (len(mean), k)), "b": np.zeros(k), "V": r.normal(0, k**-0.5, (k, k)), "G": r.normal(0, k**-0.5, (k, k)), "u": r.normal(0, k**-0.5, k), "c": r.normal(0, k**-0.5, k), "d": np.zeros(1)}

    def standard(self, x):
        return (x - self.mean.astype(x.dtype)) / self.scale.astype(x.dtype)

    def forward(self, x, first):
        """Of standardised passages: hidden rows, both gates, weights, document vectors, scores."""
        p = {k: v.astype(x.dtype, copy=False) for k, v in self.p.items()}
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["G"])
        e = (t * g) @ p["u"]
        starts, lens = first[:-1], np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), lens))
        a = e / np.repeat(np.add.reduceat(e, starts), lens)
        z = np.add.reduceat(a[:, None] * h, starts)
        return h, t, g, a, z, sigmoid(z @ p["c"] + p["d"])

    def score(self, x, first):
        return self.forward(self.standard(x.astype(np.float64)), first)[-1]

    def loss(self, x, first, y, weight):
        out = self.forward(x, first)[-1]
        return -(weight * (y * np.log(out) + (1 - y) * np.log(1 - out))).sum()

    def gradient(self, x, first, y, weight):
        """The loss's derivative by every parameter, x being standardised."""
        p, lens = self.p, np.diff(first)
        h, t, g, a, z, out = self.forward(x, first)
        dz = (out - y) * weight
        grad = {"c": z.T @ dz, "d": np.array([dz.sum()])}
        dz = np.repeat(dz[:, None] * p["c"], lens, axis=0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first[:-1]), lens))
        grad["u"] = (t * g).T @ de
        back = de[:, None] * p["u"]
        dt, dg = back * g * (1 - t * t), back * t * g * (1 - g)
        grad["V"], grad["G"] = h.T @ dt, h.T @ dg
        dh = a[:, None] * dz + dt @ p["V"].T + dg @ p["G"].T
        dh *= 1 - h * h
        grad["W"], grad["b"] = x.T @ dh.astype(x.dtype), dh.sum(0)
        return grad

    def fit(self, x, first, y, epochs=150, rate=0.02, decay=1e-4):
        x, p = self.standard(x), self.p
        share = max(y.mean(), 1e-3), max(1 - y.mean(), 1e-3)
        weight = np.where(y == 1, 0.5 / share[0], 0.5 / share[1]) / len(y)
        m = {k: np.zeros_like(v) for k, v in p.items()}
        s = {k: np.zeros_like(v) for k, v in p.items()}
        for step in range(1, epochs + 1):
            grad = self.gradient(x, first, y, weight)
            for k in self.NAMES:
                gk = grad[k] + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * gk
                s[k] = 0.99 * s[k] + 0.01 * gk * gk
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
        return self


def chosen(lengths: list[tuple[int, int]], most: int) -> list[int]:
    """Of rows (key, bytes) in order, the keys of those that together have at most `most` passages, whole."""
    out, total = [], 0
    for key, size in lengths:
        n = max(1, -(-size // PASSAGE))
        if total + n <= most:
            out.append(key)
            total += n
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, most: int = 16_000) -> Attention:
    """Fit on at most `sample` labelled documents of at most `most` passages: labels (doc_id, label 0/1).

    A document longer than what is left of `most` is passed over, never cut.
    """
    docs = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    ids = (
        labels.where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    label_of = {r.doc_id: float(r.label) for r in ids.collect()}  # bounded by sample
    known = lambda keys: F.broadcast(docs.sparkSession.createDataFrame([(k, label_of[k]) for k in keys], "doc_id long, label double"))
    # rows that repeat an id count together, so a document is in with all its rows or not at all
    lengths = docs.join(known(label_of), "doc_id").groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + PASSAGE).alias("n"))
    keys = chosen([(r.doc_id, r.n) for r in lengths.orderBy(F.xxhash64("doc_id"), "doc_id").collect()], most)

    def run(batches):
        for batch in batches:
            for part in text_chunks(batch):
                x, first = passages(part.column("text"))
                rows = [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "x"])

    rows = (
        docs.join(known(keys), "doc_id").mapInArrow(run, "doc_id long, label double, x binary").orderBy("doc_id", F.xxhash64("x")).toArrow()
    )  # at most `most` passages of 4 * WIDTH bytes
    model = fitted(rows)
    del rows
    hand_back()  # the driver keeps nothing of the sample
    return model


def fitted(rows: pa.Table) -> Attention:
    """The model of rows (label, x)."""
    if not rows.num_rows:
        model = Attention(np.zeros(WIDTH), np.ones(WIDTH))
        model.p["c"][:] = 0
        return model
    y, cells = rows.column("label").to_numpy(), Texts(rows.column("x"))
    x, first = cells.data.view(np.float32).reshape(-1, WIDTH), cells.offsets // (4 * WIDTH)
    return Attention(x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 0.02).fit(x, first, y)


def score(docs: DataFrame, model: Attention) -> DataFrame:
    """(every column of docs, score): the chance of label 1, from the text alone."""
    names = docs.columns
    out = "score"
    while out in names:  # a clashing column of the input stays
        out += "_"
    state = (model.mean, model.scale, model.p)

    def run(batches):
        own = Attention.__new__(Attention)
        own.mean, own.scale, own.p = state
        for batch in batches:
            for part in text_chunks(batch):
                x, first = passages(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.score(x, first), pa.float64())], [*names, out])

    from pyspark.sql import types as T

    return small_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
